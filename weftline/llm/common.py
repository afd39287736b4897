"""Helpers of the operators in this package: shared folders, written tables, keys of rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import application_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine) gets a temporary folder of its own; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("weftline.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "weftline-shared")
        spark.conf.set("weftline.shared.dir", found)
    return found


#: Paths that this driver has made in the shared folder and not deleted, in order.
_PATHS: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{application_folder(spark, shared_dir(spark))}/{label}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def mark() -> int:
    """A point in the list of helper tables, for ``clear``."""
    return len(_PATHS)


def clear(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Deletes the helper tables made since ``mark``, but for ``keep``. Call it when the results that read them are written: they are lazy."""
    for path in [p for p in _PATHS[since:] if p not in keep]:
        delete_path(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts lineage and survives lost executors."""
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``written``, and the table's path for ``delete_path`` when nothing reads it any more."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more, through the file system of its path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _PATHS:
        _PATHS.remove(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if it has more rows than this part of a shuffle partition's even share.
HOT = 8


def hot_keys(counts: DataFrame, total: int | None = None) -> DataFrame:
    """key, pieces: the hot keys of ``counts`` (key, n) and into how many pieces of about the same size each is cut.

    With P shuffle partitions a hot key has more than 1 / (8 P) of all rows, so there are fewer than 8 P of them
    at any size of the data: a bound that allows a broadcast. All pieces together are at most 16 P.
    """
    parts = HOT * partitions(counts.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] if total is None else total
    piece = max(1, -(-(total or 0) // parts))
    return counts.where(F.col("n") > piece).select("key", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))


def spread_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (few rows a key) on ``key``, the rows of hot keys dealt to pieces.

    Rows of ``big`` with a hot key go to a piece by the hash of the row; the rows of ``small`` with it are repeated for
    each piece. So no task reads more than a piece of a key, at one shuffle of each side. ``hot``: as ``hot_keys`` gives it.
    """
    pieces = F.broadcast(hot.select(F.col("key").alias("__hot"), F.col("pieces").alias("__pieces")))
    dealt = big.join(pieces, big[key] == F.col("__hot"), "left")
    dealt = dealt.withColumn("__piece", F.when(F.col("__pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.col("__pieces")).cast("int"))).drop("__hot", "__pieces")
    copies = small.join(pieces, small[key] == F.col("__hot"), "left")
    copies = copies.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__pieces"), F.lit(1)) - 1))).drop("__hot", "__pieces")
    return dealt.join(copies, [key, "__piece"], how).drop("__piece")


def text_or_empty(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bytes of an Arrow batch that are Python values at once, about.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of like numbers of rows and about ``size`` bytes; an empty batch is one part."""
    rows = max(1, -(-batch.num_rows // max(1, round(batch.nbytes / size))))
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)


_HELD: list = []


def held(shared, make: Callable):
    """What ``make`` builds from a broadcast value, kept over the tasks of a worker process. It holds that of one step only: workers serve one step after another."""
    if not _HELD or _HELD[0] is not shared.value:
        _HELD.clear()
        _HELD[:] = [shared.value, make(shared.value)]
    return _HELD[1]


def map_batches(df: DataFrame, columns: list[str], work: Callable[[list[list]], Iterator[list]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function from lists of column values to lists of result columns, one call for each part of an Arrow batch (``slices``)."""

    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for result in work([c.to_pylist() for c in part.columns]):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(result, out.types, strict=True)], schema=out)
        pa.default_memory_pool().release_unused()

    return df.select(*columns).mapInArrow(run, schema)
