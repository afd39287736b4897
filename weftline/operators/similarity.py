"""Similarity join of short texts by T04 without comparing all pairs of a block.

The score of two texts is 1 if they are equal, the ratio of their lengths if one holds the other, else twice the matched
characters over those of both. None of the three exceeds twice the characters that both texts share, with repeats, over
those of both. So a text is a set of numbered characters (the second e is another element than the first), and two texts
that reach ``least`` must share as many elements as that bound asks for. In an order that all texts share, rare
elements first, they then have an element of their prefixes in common: texts are indexed by those. Candidates of unequal length, or whose
common elements come too late, are dropped in the join; the shared elements are counted in the JVM; only what is left is compared in Python.

An element of a block that many texts have in their prefix is dealt to several tasks, and repeated texts of a block are one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.functions import text
from weftline.session import partitions

#: Elements that most texts have, in the order of their frequency; all others come before them. At most so many are counted.
MOST_COMMON = 2_000
#: Rows of one block and element that one task joins with their like.
ROWS = 2_000
#: Pairs of rows of one key that one task makes, about.
PAIRS = 20_000_000
MARGIN = 1e-9


def elements(value: str) -> list[int]:
    """The characters with their repeats numbered, as integers."""
    seen: Counter[str] = Counter()
    out = []
    for c in value:
        out.append(ord(c) << 12 | min(seen[c], 4095))
        seen[c] += 1
    return out


def least_shared(n: int, least: float) -> float:
    """Elements that a text of n must share at least with any partner: one of the shortest length that can reach ``least``."""
    return least * n / (2 - least)


def _common(texts: DataFrame) -> list[int]:
    """The most frequent elements, rare ones first, counted in each task before they are summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total.update(elements(value))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["element", "n"])

    counts = texts.mapInArrow(count, "element bigint, n bigint").groupBy("element").agg(F.sum("n").alias("n"))
    return [r.element for r in reversed(counts.orderBy(F.desc("n"), "element").limit(MOST_COMMON).collect())]


def indexed(texts: DataFrame, common: list[int], least: float) -> DataFrame:
    """``texts`` (block, value) with n, items (all elements in the shared order) and those of the prefix as rows (at, element)."""
    shared = texts.sparkSession.sparkContext.broadcast({e: k for k, e in enumerate(common)})

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            items = [sorted(elements(v), key=lambda e: (rank.get(e, -1), e)) for v in batch.column(1).to_pylist()]
            # A prefix has one element more than a text may lack.
            cut = [len(x) - max(1, -int(-(least_shared(len(x), least) - MARGIN) // 1)) + 1 for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.list_(pa.int64())), pa.array(cut, pa.int32())], names=["block", "value", "items", "cut"])

    rows = texts.mapInArrow(order, "block string, value string, items array<bigint>, cut int")
    return rows.withColumn("n", F.size("items")).select("block", "value", "n", "items", F.posexplode(F.slice("items", F.lit(1), F.col("cut"))).alias("at", "element"))


@F.pandas_udf(DoubleType())
def matched(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; equal pairs of a batch are compared once, and pairs with one second text share its index."""
    known: dict[tuple[str, str], float] = {}
    matcher = SequenceMatcher(None)
    for x, y in sorted(set(zip(a, b, strict=True)), key=lambda p: p[::-1]):
        if matcher.b != y:
            matcher.set_seq2(y)
        matcher.set_seq1(x)
        known[x, y] = matcher.ratio()
    return pd.Series([known[p] for p in zip(a, b, strict=True)], dtype="float64")


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """block, a, b: each pair once that can reach ``least``: of ``left`` and ``right`` (block string, value string), distinct rows without blanks."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity lies between 0 and 1")
    common = _common(left.select("value").unionByName(right.select("value")))
    one, two = indexed(left, common, least), indexed(right, common, least)
    # Hot elements: the rows of one side are dealt, those of the other copied to each piece.
    counts = one.groupBy("block", "element").agg(F.count("*").alias("__n")).where(F.col("__n") > ROWS)
    pieces = counts.select("block", "element", F.ceil(F.col("__n") / ROWS).cast("int").alias("pieces"))
    dealt = one.join(pieces, ["block", "element"], "left").withColumn("piece", F.pmod(F.xxhash64("value"), F.coalesce("pieces", F.lit(1))).cast("int"))
    copied = two.join(pieces, ["block", "element"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    a = dealt.select("block", "element", "piece", F.col("value").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("items").alias("items_a"))
    b = copied.select("block", "element", "piece", F.col("value").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("items").alias("items_b"))
    owed = (F.col("n_a") + F.col("n_b")) * least / 2 - MARGIN
    # Of the elements that both have, the first in the order is one of both prefixes: there the pair is made, and from there on lie all others.
    near = F.least("n_a", "n_b") >= owed
    reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= owed
    shared = F.array_intersect("items_a", "items_b")
    met = a.join(b, ["block", "element", "piece"]).where(near & reach)
    return met.where((F.size(shared) >= owed) & (F.get(shared, F.lit(0)) == F.col("element"))).select("block", "a", "b")


def similar_pairs(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, least: float, contained: bool = True) -> DataFrame:
    """T04 over blocks: the columns ``block``, a, b and similarity of all pairs of distinct texts of a block with ``least`` or more.

    left has a, right has b. Rows with a null block or a null or blank text have no partner. ``contained``: containment gives the ratio of lengths, as
    T04 says; else the ratio of matched characters counts for all unequal texts. Equal to comparing all pairs of each block, for any data.
    """
    key = F.to_json(F.struct(*block))

    def distinct(df: DataFrame, column: str) -> DataFrame:
        there = F.col(column).isNotNull() & (F.col(column) != "")
        for c in block:
            there = there & F.col(c).isNotNull()
        return df.where(there).select(key.alias("block"), F.col(column).alias("value")).distinct()

    pairs = candidates(distinct(left, a), distinct(right, b), least)
    held = text.containment(F.col("a"), F.col("b")) if contained else F.when(F.col("a") == F.col("b"), 1.0)
    known = pairs.withColumn("similarity", held)
    # What needs Python is dealt out first, so that a hot block is compared by many tasks.
    unsure = known.where("similarity is null").repartition(partitions(left.sparkSession), "a", "b").withColumn("similarity", matched("a", "b"))
    found = known.where("similarity is not null").unionByName(unsure).where(F.col("similarity") >= least)
    kinds = dict(left.dtypes)
    fields = F.from_json("block", ", ".join(f"`{c}` {kinds[c]}" for c in block))
    return found.select(fields.alias("__block"), F.col("a").alias("__a"), F.col("b").alias("__b"), "similarity").select(*[F.col("__block")[c].alias(c) for c in block], F.col("__a").alias(a), F.col("__b").alias(b), "similarity")


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on ``keys``, whose pairs may be many: rows of a key with more than ``PAIRS`` pairs are dealt to pieces on the left, and those on the right copied to each. Both are read twice.

    No key's pairs are made by one task, and the copies are fewer than the pairs: a row on the right is copied once for each ``PAIRS`` pairs of its key at most.
    """
    n = left.groupBy(*keys).agg(F.count("*").alias("__n")).join(right.groupBy(*keys).agg(F.count("*").alias("__m")), keys)
    pieces = n.withColumn("__pieces", F.least(F.col("__n"), F.ceil(F.col("__n") * F.col("__m") / PAIRS)).cast("int")).where("__pieces > 1").select(*keys, "__pieces")
    one = F.coalesce("__pieces", F.lit(1))
    dealt = left.join(pieces, keys, "left").withColumn("__piece", F.pmod(F.xxhash64(*left.columns), one).cast("int")).drop("__pieces")
    copied = right.join(pieces, keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), one - 1))).drop("__pieces")
    # Few rows make many pairs, so their size must not put pieces together again.
    spread = lambda df: df.repartition(partitions(df.sparkSession), *keys, "__piece")
    return spread(dealt).join(spread(copied), [*keys, "__piece"]).drop("__piece")


def best_similar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of the pairs with the same ``by`` the most alike ones, all ties. A text's partners are few, as each reaches the least similarity."""
    return pairs.withColumn("__best", F.max("similarity").over(Window.partitionBy(*by))).where("similarity = __best").drop("__best")


def confidence(base: float, gain: float, similarity: Column) -> Column:
    """What a fuzzy match counts: linear in its similarity, to four places."""
    return F.round(F.lit(base) + gain * similarity, 4)
