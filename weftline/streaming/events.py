"""Structured Streaming forms of the incremental behaviours: event summaries and keyed upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from weftline.operators.ranking import latest


def read_events(spark: SparkSession, folder: str, schema: str, name: str = "*", files: int = 1) -> DataFrame:
    """A file source over an append-only folder, ``files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)


def summary(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """N and total of each kind in tumbling windows, events later than the watermark left out; the same plan for a table and a stream."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("__t", late)
    by = stamped.groupBy(F.window("__t", width), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("window.start").alias("start"), "kind", "n", F.round("total", 4).alias("total"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a memory table of the driver, for tests and results of a few rows."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into Parquet files, exactly once; windows that the watermark hasn't closed yet wait for the next run."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, keys: list[str], time: str, seq: str, parts: int = 64) -> None:
    """Keeps in ``target`` the latest row of each key by (time, seq), whatever order files come in.

    Keys are dealt to ``parts`` parts by hash; a batch rewrites the parts that its keys lie in and leaves the others as they
    are. A state file of each batch names the version of every part, so a reader sees a batch whole or not at all, and a batch
    that runs again after a failure writes the same version. Versions that neither of the last two states names are deleted.
    """
    spark = stream.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("part", part).persist()
        touched = [r.part for r in rows.select("part").distinct().collect()]  # at most ``parts``
        before = _state(spark, target, number - 1)
        old = [f"{target}/v{before[p]}/part={p}" for p in touched if p in before]
        merged = rows
        if old:
            merged = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("part", part))
        latest(merged, keys, time, seq).repartition(max(1, len(touched)), "part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/v{number}")
        rows.unpersist()
        now = before | {p: number for p in touched}
        spark.createDataFrame(sorted(now.items()), "part int, version long").coalesce(1).write.mode("overwrite").json(f"{target}/state/{number}")
        used = {*now.items(), *before.items()}
        files = _files(spark, target)
        for p, version in _state(spark, target, number - 2).items():
            if (p, version) not in used:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v{version}/part={p}"), True)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _state(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """The version of each part after a batch; empty before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/state/{number}/_SUCCESS")
    if number < 0 or not _files(spark, target).exists(path):
        return {}
    return {r.part: r.version for r in spark.read.schema("part int, version long").json(f"{target}/state/{number}").collect()}


def newest_version(spark: SparkSession, target: str) -> DataFrame:
    """The target of ``upsert_stream``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/state")
    names = [int(s.getPath().getName()) for s in _files(spark, target).listStatus(path)]
    for number in sorted(names, reverse=True):
        if state := _state(spark, target, number):
            return spark.read.option("mergeSchema", True).parquet(*[f"{target}/v{v}/part={p}" for p, v in sorted(state.items())])
    raise ValueError(f"{target} has no whole version")


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left after a checkpoint."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def token_bucket(events: DataFrame, key: str, time: str, per_minute: float) -> DataFrame:
    """Admits events of each key by a token bucket of capacity rpm / 12 (at least 1), refilled at rpm / 60 a second: key, time, admitted.

    As a stream the bucket is the key's state; events count in order of time within a trigger.
    """
    capacity, rate = max(1.0, per_minute / 12), per_minute / 60
    schema = f"{key} {dict(events.dtypes)[key]}, seconds double, admitted boolean"

    def fold(seconds: list[float], tokens: float, last: float | None) -> tuple[list[bool], float, float | None]:
        out = []
        for now in seconds:
            tokens = min(capacity, tokens + (now - last) * rate) if last is not None else capacity
            last = now
            out.append(tokens >= 1)
            tokens -= tokens >= 1
        return out, tokens, last

    timed = events.select(key, F.col(time).cast("timestamp").cast("double").alias("seconds"))
    if events.isStreaming:

        def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            tokens, last = state.get if state.exists else (capacity, None)
            seconds = sorted(s for f in frames for s in f["seconds"])
            admitted, tokens, last = fold(seconds, tokens, last)
            state.update((tokens, last))
            yield pd.DataFrame({key: [k[0]] * len(seconds), "seconds": seconds, "admitted": admitted})

        return timed.groupBy(key).applyInPandasWithState(step, schema, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Keys follow each other in order of time; the bucket of the last key goes on over the batches.
        current, tokens, last = None, capacity, None
        for frame in frames:
            admitted: list[bool] = []
            for k, part in frame.groupby(key, sort=False, dropna=False):
                if not (k == current or (k != k and current != current)):
                    tokens, last = capacity, None
                current = k
                got, tokens, last = fold(part["seconds"].tolist(), tokens, last)
                admitted += got
            yield frame.assign(admitted=admitted)

    return timed.repartition(key).sortWithinPartitions(key, "seconds").mapInPandas(rows, schema)
