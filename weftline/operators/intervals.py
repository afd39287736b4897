"""Gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_union(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per key the merged intervals: island, start, end. Intervals that touch are one."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.max(end).over(before).isNull() | (F.col(start) > F.max(end).over(before))).cast("int")
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("opens", opens).withColumn("island", F.sum("opens").over(upto))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"))


def gap_groups(df: DataFrame, keys: list[str], order: str, gap: float, out: str = "group") -> DataFrame:
    """Numbers the runs of each key whose steps stay within ``gap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    far = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return df.withColumn("far", F.coalesce(far, F.lit(0))).withColumn(out, F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("far")
