"""Writers. Spark's committers make each write all or nothing; a replaced table is written beside the old one first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """Parquet, json or csv (header)."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("parquet", "json", "orc"):
        writer.format(kind).save(path)
    else:
        raise ValueError(f"no writer for {kind}")


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a staging folder whole, then moves the old table aside and the new one into its place.

    A failed write leaves the old table as it is, and a failed move puts it back. Between the two moves there is a moment
    without a table, as file systems can't exchange folders; what an earlier run has left is cleared first.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old, target = hadoop.Path(f"{path}.staging"), hadoop.Path(f"{path}.old"), hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(old):
        if files.exists(target):
            files.delete(old, True)
        elif not files.rename(old, target):
            raise OSError(f"can't put {path}.old back")
    df.write.mode("overwrite").parquet(f"{path}.staging")
    there = files.exists(target)
    if there and not files.rename(target, old):
        raise OSError(f"can't move {path} aside")
    if not files.rename(new, target):
        if there:
            files.rename(old, target)
        raise OSError(f"can't move {path}.staging into place")
    files.delete(old, True)


def append_log(df: DataFrame, path: str) -> None:
    """Appends events to a JSON lines log, which is a streaming source as well."""
    df.write.mode("append").json(path)


def nested(df: DataFrame, table: str, score: str, columns: list[str]) -> DataFrame:
    """A row for each table with its recommendations, best first."""
    item = F.struct((-F.col(score)).alias("__order"), *columns)
    sorted_ = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return df.groupBy(table).agg(sorted_.alias("recommendations"))
