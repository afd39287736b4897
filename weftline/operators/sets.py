"""Set operations over aligned columns and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.mapping import number_order


def union_aligned(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name, columns that are missing null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_sorted(column: str, *frames: DataFrame) -> DataFrame:
    """UNION ALL by name in order of a column that is read as a number; what is none comes last."""
    return union_aligned(*frames).orderBy(number_order(F.col(column)))


def union_distinct(*frames: DataFrame) -> DataFrame:
    """U03."""
    return union_aligned(*frames).distinct()


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    one, two = a.select(*keys).distinct(), b.select(*keys).distinct()
    return one.exceptAll(two).withColumn("side", F.lit("left")).unionAll(two.exceptAll(one).withColumn("side", F.lit("right")))


def shared_variants(df: DataFrame, id_column: str, variants: list[Column]) -> DataFrame:
    """Variants of keys that more than one id has: variant, n_ids, first_id."""
    each = df.select(F.col(id_column).alias("id"), F.explode(F.array_distinct(F.array(*variants))).alias("variant")).where("variant <> ''")
    return each.groupBy("variant").agg(F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id")).where("n_ids > 1")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of ids on both sides, and whether the sets are equal."""
    both = a.select(key).distinct().withColumn("l", F.lit(1)).join(b.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    out = both.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"))
    return out.withColumn("equal_sets", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def ordered_union(*lists: Column) -> Column:
    """Elements of lists in order, each once."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def path_diff(a: DataFrame, b: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Paths whose values differ, as flattened documents; missing and null are different from any value."""
    two = b.select(F.col(path).alias("p2"), F.col(value).alias("new"))
    both = a.select(F.col(path).alias("p1"), F.col(value).alias("old")).join(two, F.col("p1") == F.col("p2"), "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")) | F.col("p1").isNull() | F.col("p2").isNull()).select(F.coalesce("p1", "p2").alias(path), "old", "new")
