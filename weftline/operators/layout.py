"""Page geometry: boilerplate bands, merged lines, label statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.intervals import gap_groups, interval_union
from weftline.operators.ranking import first_by


def page_boilerplate(lines: DataFrame, pages: int, band: float = 0.08, drift: float = 3.0) -> DataFrame:
    """Texts on at least max(3, half the pages), always at one height within ``drift`` and in the outer band of the page (top, page_height)."""
    at_edge = (F.col("top") <= band * F.col("page_height")) | (F.col("top") >= (1 - band) * F.col("page_height"))
    by = lines.groupBy("text").agg(F.count_distinct("page").alias("pages"), (F.max("top") - F.min("top")).alias("drift"), F.bool_and(at_edge).alias("edge"))
    return by.where((F.col("pages") >= max(3, -(-pages // 2))) & (F.col("drift") <= drift) & F.col("edge")).select("text", "pages")


def modal_size(lines: DataFrame, key: str, size: str = "size") -> DataFrame:
    """The most frequent size of each key, weighted by characters; of equals the smallest."""
    counts = lines.groupBy(key, F.round(size, 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return first_by(counts, [key], F.col("n").desc(), F.col("size").asc())


def words(chars: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Characters (x0, text) of a line as words, split where the step to the next is over ``gap``."""
    grouped = gap_groups(chars, keys, "x0", gap, "word")
    return grouped.groupBy(*keys, "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda c: c["text"]), "").alias("text"), F.min("x0").alias("x0"))


def merged_lines(lines: DataFrame, key: str, leading: float) -> DataFrame:
    """Wrapped lines of a column as one text: a line goes on if it starts where the last did, close below, and that did not end a sentence."""
    w = Window.partitionBy(key).orderBy("top")
    goes_on = (F.abs(F.col("x0") - F.lag("x0").over(w)) < 1) & (F.col("top") - F.lag("bottom").over(w) <= leading) & ~F.lag("text").over(w).rlike(r"[.:?!]\s*$")
    marked = lines.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "block").agg(F.min("top").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "text"))), lambda x: x["text"]), " ").alias("text"))


def grid_cells(words: DataFrame, key: str, gap: float = 0.0) -> DataFrame:
    """The words (top, x0, x1, text) of a page as cells: row (by top), column, text.

    Columns are the bands that words cover from left to right over all lines, those at most ``gap`` apart being one; words of a
    line in one band are joined by a space. A word lies in exactly one band.
    """
    bands = interval_union(words.select(key, "x0", (F.col("x1") + gap).alias("x1")), [key], "x0", "x1").select(key, F.col("start").alias("__a"), F.col("end").alias("__b"), "island")
    numbered = bands.withColumn("column", F.row_number().over(Window.partitionBy(key).orderBy("__a"))).drop("island")
    placed = words.join(numbered, key).where((F.col("x0") >= F.col("__a")) & (F.col("x0") <= F.col("__b")))
    placed = placed.withColumn("row", F.dense_rank().over(Window.partitionBy(key).orderBy("top")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"])
    return placed.groupBy(key, "row", "column").agg(F.array_join(said, " ").alias("text"))


def page_ranges(outline: DataFrame, key: str, last_page: str, depth: int = 9) -> DataFrame:
    """Entries (level from 1, page) with the page before the next entry of the same or a higher level as their end.

    For each of the ``depth`` levels the next entry that ends it is looked up, so no row gathers its followers; a deeper level is an error.
    """
    following = Window.partitionBy(key).orderBy("page", "level").rowsBetween(1, Window.unboundedFollowing)
    stops = [F.first(F.when(F.col("level") <= n, F.col("page")), ignorenulls=True).over(following) for n in range(1, depth + 1)]
    deep = F.raise_error(F.concat(F.lit("outline level "), F.col("level").cast("string"))).cast("int")
    level = F.when(F.col("level") > depth, deep).otherwise(F.greatest(F.col("level"), F.lit(1)))
    found = outline.withColumn("__stop", F.element_at(F.array(*stops), level.cast("int")))
    return found.withColumn("end", F.greatest(F.col("page"), F.coalesce(F.col("__stop") - 1, F.col(last_page)))).drop("__stop")


def outline_level(outline: DataFrame, key: str) -> DataFrame:
    """The level that most entries of a document have, of equals the highest: level, n."""
    return first_by(outline.groupBy(key, "level").agg(F.count("*").alias("n")), [key], F.col("n").desc(), F.col("level").asc())
