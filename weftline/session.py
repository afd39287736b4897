"""Session defaults and table access shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weftline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where that is unset, a local session (one machine) takes a temporary folder; on a cluster it is an error.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "weftline-shared")
    return f"{application_folder(spark, top)}/{label}-{uuid.uuid4().hex}"


#: Folders of applications that this driver has made.
_FOLDERS: set[str] = set()


def application_folder(spark: SparkSession, top: str) -> str:
    """The folder of this application below ``top``: what is written on the way lies there and is deleted when the driver ends. Results are lazy, so nothing goes before."""
    folder = f"{top}/weftline-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS.add(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: what is used several times is computed once and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of ``dealt`` gets, about.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as its number of rows asks for; under ``ROWS_A_TASK`` it stays as it is.

    Adaptive execution puts shuffle partitions together by their bytes. Rows of a few short columns are packed to a few bytes each, and
    a task then gets millions of them, which its sorts and hash tables hold unpacked. A number that is given is left alone.
    """
    if rows <= ROWS_A_TASK:
        return df
    return df.repartition(max(-(-rows // ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism), *keys)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
