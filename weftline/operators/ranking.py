"""Ranking, deduplication and ordering by key. Order is always a column: Spark has no row order of its own."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import written


def score_of(c: Column) -> Column:
    """A score that doesn't parse, or is no number, counts 0."""
    number = c.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(number)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, first in ``order``; the row limit reaches the map side (WindowGroupLimit)."""
    return top_by(df, keys, 1, *order).drop("rank")


def top_by(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key, numbered in ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def best_scored(df: DataFrame, keys: list[str], score: str, seq: str) -> DataFrame:
    """The best-scored row of each key; the first of equals."""
    return first_by(df, keys, score_of(F.col(score)).desc(), F.col(seq).asc())


def best_keep_place(df: DataFrame, keys: list[str], score: str, seq: str) -> DataFrame:
    """The best row of each key, at the place (``place``) where the key came first."""
    w = Window.partitionBy(*keys)
    return first_by(df.withColumn("place", F.min(seq).over(w)), keys, score_of(F.col(score)).desc(), F.col(seq).asc())


def latest(df: DataFrame, keys: list[str], time: str, seq: str) -> DataFrame:
    """The last write of each key by time, then by write order."""
    return first_by(df, keys, F.col(time).desc_nulls_last(), F.col(seq).desc())


def prefer_source(df: DataFrame, keys: list[str], priority: str, seq: str) -> DataFrame:
    """First occurrence by source priority."""
    return first_by(df, keys, F.col(priority).asc(), F.col(seq).asc())


def unique_labels(df: DataFrame, table: str, label: str, seq: str, out: str = "unique_label") -> DataFrame:
    """Repeated labels of a table get _2, _3, ... in order."""
    n = F.row_number().over(Window.partitionBy(table, label).orderBy(seq))
    return df.withColumn(out, F.when(n == 1, F.col(label)).otherwise(F.concat_ws("_", label, n.cast("string"))))


def round_robin(df: DataFrame, stratum: str, *order: Column, limit: int | None = None) -> DataFrame:
    """Strata take turns; ``turn`` is the round. With ``limit`` that many rows in all."""
    dealt = df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return dealt if limit is None else dealt.orderBy("turn", stratum).limit(limit)


def next_start(df: DataFrame, keys: list[str], start: str, out: str = "end") -> DataFrame:
    """Each row's range ends before the next sibling starts."""
    return df.withColumn(out, F.lead(start).over(Window.partitionBy(*keys).orderBy(start)) - 1)


def running_context(df: DataFrame, keys: list[str], order: str, value: str, most: int, out: str = "context") -> DataFrame:
    """The values of up to ``most`` preceding siblings, oldest first."""
    return df.withColumn(out, F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-most, -1)))


def folded(df: DataFrame, keys: list[str], order: list[str], columns: list[str], answer: Callable[[dict, list], str | None], most: int = 15, done: str | None = None, out: str = "answer") -> DataFrame:
    """W20 with feedback: the rows of each key in order, each answered with the answers of up to ``most`` rows before it.

    answer(row, earlier) gets the ``columns`` of a row and the earlier answers, oldest first, and runs on the executors. A row whose
    column ``done`` is filled keeps that as its answer and hands it on. A null answer isn't handed on. A key is one sequence by its nature; its
    state is ``most`` answers, however many rows it has, and keys are dealt to tasks.
    """
    kept = list(dict.fromkeys([*keys, *order, *columns, *([done] if done else [])]))
    dealt = df.select(*kept).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join([*[f"`{c}` {t}" for c, t in dealt.dtypes], f"`{out}` string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, earlier = None, deque(maxlen=most)
        for frame in frames:
            answers = []
            for row in frame.to_dict("records"):
                key = tuple(None if pd.isna(row[k]) else row[k] for k in keys)
                if key != current:
                    current, earlier = key, deque(maxlen=most)
                given = row[done] if done else None
                said = given if given is not None and not pd.isna(given) else answer(row, list(earlier))
                if said is not None:
                    earlier.append(said)
                answers.append(said)
            yield frame.assign(**{out: answers})

    return dealt.mapInPandas(run, schema)


def within_budget(df: DataFrame, keys: list[str], order: Column | str, size: Column, budget: int) -> DataFrame:
    """Rows of each key as long as the running size stays within the budget."""
    total = F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", total).where(F.col("used") <= budget)


def ordered_distinct(df: DataFrame, keys: list[str], seq: str, value: str, n: int) -> DataFrame:
    """The first ``n`` distinct values of each key in order of first occurrence: value, place."""
    seen = df.groupBy(*keys, value).agg(F.min(seq).alias("place"))
    return top_by(seen, keys, n, F.col("place"), F.col(value))


def severity_order(c: Column) -> Column:
    """Error before warning before the rest."""
    return F.when(F.lower(c) == "error", 0).when(F.lower(c) == "warning", 1).otherwise(2)


def by_score(df: DataFrame, table: str, score: str, seq: str) -> DataFrame:
    """The rows of each table numbered (place) by score, best first."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(table).orderBy(score_of(F.col(score)).desc(), F.col(seq).asc())))


def numbered(df: DataFrame, *order: str, out: str = "number") -> DataFrame:
    """Rows numbered from 1 in one order over the whole table.

    The table is sorted by ranges and written with the place of each row in its range; the rows before a range are a sum over
    one row for each range. So no task sees more than its range.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = written(sorted_, "numbered").withColumn("__range", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__range").withColumn(out, F.col("__before") + F.col("__place") + 1).drop("__id", "__range", "__place", "__before")


def above(df: DataFrame, score: str, least: float) -> DataFrame:
    """rows with a score of ``least`` at least; a score that is no number counts 0."""
    return df.where(score_of(F.col(score)) >= least)
