"""Group profiles: counts, shares, modes with a share threshold, checks over whole groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import first_by


def group_summary(df: DataFrame, key: str, flag: Column, distinct: str, first: str) -> DataFrame:
    """Per group n, n_flag, n_distinct, first_value (least), share in percent with one decimal."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flag"), F.count_distinct(distinct).alias("n_distinct"), F.min(first).alias("first_value"))
    return out.withColumn("share", F.round(100.0 * F.col("n_flag") / F.col("n"), 1))


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, total, share: how a value is spread within its key; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("n_values"))
    return counts.join(totals, keys).withColumn("share", F.col("n") / F.col("total"))


def stable_mode(df: DataFrame, keys: list[str], value: str, share: float = 0.8) -> DataFrame:
    """The most frequent value of each key where its share is large enough; of equals the least."""
    return first_by(shares(df, keys, value), keys, F.col("n").desc(), F.col(value).asc()).where(F.col("share") >= share)


def prefix_mode(df: DataFrame, key: str, value: str, width: int = 2, share: float = 0.8, prefix_share: float = 0.9) -> DataFrame:
    """Stable modes per key, then over these the stable mode per prefix of the key."""
    stable = stable_mode(df, [key], value, share).select(F.substring(F.col(key).cast("string"), 1, width).alias("prefix"), value)
    return stable_mode(stable, ["prefix"], value, prefix_share)


def disambiguation(df: DataFrame, key: str, group: str, value: str, share: float = 0.8) -> DataFrame:
    """For keys in several groups the stable mode of each key and group."""
    several = df.groupBy(key).agg(F.count_distinct(group).alias("g")).where("g > 1").select(key)
    return stable_mode(df.join(several, key, "left_semi"), [key, group], value, share)


def flagged_groups(df: DataFrame, key: str, flag: Column, share: float = 0.9) -> DataFrame:
    """A10: groups where the flag holds for at least ``share`` of the rows."""
    return df.groupBy(key).agg(F.avg(F.when(flag, 1.0).otherwise(0.0)).alias("ratio"), F.count("*").alias("n")).where(F.col("ratio") >= share)


def fragmented_groups(df: DataFrame, key: str, value: str, rows: int = 3, values: int = 2, top: float = 0.5) -> DataFrame:
    """Groups of at least ``rows`` rows with more than ``values`` values of which none reaches the share ``top``."""
    by = shares(df, [key], value).groupBy(key).agg(F.max("total").alias("n"), F.max("n_values").alias("n_values"), F.max("share").alias("top_share"))
    return by.where((F.col("n") >= rows) & (F.col("n_values") > values) & (F.col("top_share") < top))


def orphans(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with exactly one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1").drop("n")


def multi_source(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Keys that come from more than one source, with the sources in order."""
    return df.groupBy(*keys).agg(F.count_distinct(source).alias("n_sources"), F.array_join(F.array_sort(F.collect_set(F.col(source).cast("string"))), ",").alias("sources")).where("n_sources > 1")


def extra_assignments(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sum over keys of distinct names, case folded, beyond the first."""
    return df.groupBy(*keys).agg(F.count_distinct(F.lower(name)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("extra"), F.count_if(F.col("k") > 1).alias("n_keys"))


def priority_ratio(df: DataFrame, key: str, source: str, priority: dict[str, int], worst: int) -> DataFrame:
    """Best source of each key by priority; how many keys end at ``worst``, of those that have a source at all."""
    rank = F.coalesce(*[F.when(F.col(source) == s, p) for s, p in priority.items()])
    best = df.where(rank.isNotNull()).groupBy(key).agg(F.min(rank).alias("best"))
    return best.agg(F.count("*").alias("n"), F.count_if(F.col("best") >= worst).alias("n_worst")).withColumn("ratio", F.round(F.col("n_worst") / F.col("n"), 4))


def score_bins(df: DataFrame, key: str, score: str) -> DataFrame:
    """Keys by band of their best score."""
    best = df.groupBy(key).agg(F.max(score).alias("best"))
    bin_ = F.when(F.col("best") >= 0.9, "0.9+").when(F.col("best") >= 0.7, "0.7-0.9").when(F.col("best") >= 0.5, "0.5-0.7").otherwise("<0.5")
    return best.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def boilerplate_lines(df: DataFrame, doc: str, line: str, at_least: int = 3) -> DataFrame:
    """Lines of at least ``at_least`` documents."""
    return df.where(F.trim(line) != "").groupBy(line).agg(F.count_distinct(doc).alias("n_docs")).where(F.col("n_docs") >= at_least)


def severities(df: DataFrame, key: str, severity: str) -> DataFrame:
    """The worst severity of each key, and counts."""
    rank = F.when(F.lower(severity) == "error", 2).when(F.lower(severity) == "warning", 1).otherwise(0)
    return df.groupBy(key).agg(F.max_by(F.lower(F.col(severity)), rank).alias("worst"), F.count("*").alias("n"))


def garbled_ratio(c: Column, bad: str = "�") -> Column:
    """Share of unreadable characters of a text."""
    return F.when(F.length(c) > 0, (F.length(c) - F.length(F.replace(c, F.lit(bad), F.lit("")))) / F.length(c)).otherwise(0.0)


def confidence(scores: Column) -> Column:
    """Best score, and 0.1 more if the runner-up is over 0.3, 1 at most."""
    ranked = F.sort_array(scores, asc=False)
    extra = F.when(F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0)) > 0.3, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.coalesce(F.get(ranked, F.lit(0)), F.lit(0.0)) + extra)
