"""Scores against a truth table, metrics by slice, paired bootstrap, acceptance and regression gates."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import diff_status


def score(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Truth (key, domain, variable) against predictions (key, ai_domain, ai_variable): status, extra rows flagged.

    A truth without a prediction is ``missing``; predictions without a truth are ``extra``.
    """
    both = truth.withColumn("__t", F.lit(1)).join(predicted.withColumn("__p", F.lit(1)), key, "full")
    status = F.when(F.col("__t").isNull(), "extra").when(F.col("__p").isNull(), "missing").otherwise(diff_status(F.col("ai_domain"), F.col("ai_variable"), F.col("domain"), F.col("variable")))
    return both.withColumn("status", status).drop("__t", "__p")


def sliced(df: DataFrame, slices: list[str], match: Column) -> DataFrame:
    """Total and matches by each slice and overall in one pass (GROUPING SETS): slice_kind, slice, total, matched, rate."""
    one = df.select(*slices, match.cast("int").alias("__m"))
    kinds = F.when(F.grouping_id() == (1 << len(slices)) - 1, "all")
    for i, s in enumerate(slices):
        kinds = kinds.when(F.grouping_id() == (1 << len(slices)) - 1 - (1 << len(slices) - 1 - i), s)
    sets = [[F.col(s)] for s in slices] + [[]]
    out = one.groupingSets(sets, *[F.col(s) for s in slices]).agg(F.count("*").alias("total"), F.coalesce(F.sum("__m"), F.lit(0)).alias("matched"), kinds.alias("slice_kind"))
    value = F.coalesce(*[F.col(s).cast("string") for s in slices], F.lit("all"))
    return out.select("slice_kind", value.alias("slice"), "total", "matched", F.round(F.col("matched") / F.col("total"), 4).alias("rate"))


def precision_recall(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Tp, fp, fn, precision, recall, f1 in one row; 0 where a denominator is."""
    counts = df.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"))
    safe = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def set_scores(truth: DataFrame, found: DataFrame, group: str, key: str) -> DataFrame:
    """Per group the sizes of both sets and of what they share."""
    t, f = truth.select(group, key).distinct().withColumn("t", F.lit(1)), found.select(group, key).distinct().withColumn("f", F.lit(1))
    both = t.join(f, [group, key], "full").groupBy(group)
    return both.agg(F.count("t").alias("n_truth"), F.count("f").alias("n_found"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("n_shared"))


def quality_counters(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row with a count for each condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in counters.items()])


def bootstrap(pairs: DataFrame, key: str, baseline: Column, candidate: Column, rounds: int = 10_000, seed: int = 20260726) -> DataFrame:
    """Mean difference of paired outcomes and its 95 % interval (nearest rank) by Poisson resampling.

    Each pair is drawn a Poisson(1) number of times in each round. All pairs with one difference are drawn a Poisson(n) number
    of times together, which is the same distribution, so the cost of the rounds hangs on how many differences there are and
    not on the rows: for outcomes right or wrong there are three. A generator seeded by the difference gives the draws: any partitioning gives the same.
    Differences of a finer kind are drawn one by one in the tasks that hold them.
    """
    diff = pairs.select((candidate.cast("double") - baseline.cast("double")).alias("d"))
    counts = diff.where("d is not null").groupBy("d").agg(F.count("*").alias("n"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            for d, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                draws = np.random.default_rng([seed, *struct.unpack("<II", struct.pack("<d", d))]).poisson(n, rounds)
                total += draws * d
                count += draws
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds), pa.int32()), pa.array(total), pa.array(count)], names=["round", "total", "count"])

    by_task = counts.mapInArrow(sums, "round int, total double, count double")
    means = by_task.groupBy("round").agg((F.sum("total") / F.sum("count")).alias("mean")).where("mean is not null")
    ends = means.agg(F.expr("percentile_disc(0.025) within group (order by mean)").alias("low"), F.expr("percentile_disc(0.975) within group (order by mean)").alias("high"))
    whole = diff.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("delta"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"))
    return whole.crossJoin(ends.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high")))  # one row by one row


def gates(metrics: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """A row for each rule over a one-row table: gate, passed; and the verdict over all."""
    each = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules])
    verdict = F.when(F.forall(each, lambda g: g["passed"]), "ACCEPT").otherwise("ROLLBACK")
    return metrics.select(each.alias("g"), verdict.alias("verdict")).select(F.inline("g"), "verdict")


def tolerance(current: DataFrame, baseline: DataFrame, slack: float, higher_is_better: bool = True) -> DataFrame:
    """Metric by metric, current within ``slack`` of the baseline; a metric that is missing fails."""
    both = baseline.select("metric", F.col("value").alias("base")).join(current.select("metric", F.col("value").alias("now")), "metric", "left")
    ok = F.col("now") >= F.col("base") - slack if higher_is_better else F.col("now") <= F.col("base") + slack
    return both.withColumn("passed", F.coalesce(ok, F.lit(False)))
