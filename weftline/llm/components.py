"""Connected components of an edge list, as repeated joins: no component, link or hub passes through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import delete_path, hot_keys, new_path, spread_join, written


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it can reach) for each node of ``edges``; nodes that compare as long integers.

    Every round each node takes the least label among its neighbours and itself, then the label of its label, which
    doubles the reach. Minima are taken map-side first, so a hub sends one row from each task; the edges of a hub, and the
    nodes that share one label, are dealt to many tasks in both joins. Each round's labels are a written table, deleted
    when the next one is there; it ends when no label changed. Null ends are left out, loops are kept as nodes, repeated
    edges change nothing.
    """
    spark = edges.sparkSession
    clean = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = written(clean.unionAll(clean.select(F.col("y"), F.col("x"))).distinct(), "edges")
    degrees = written(hot_keys(both.groupBy("y").agg(F.count("*").alias("n")).select(F.col("y").alias("key"), "n"), both.count()), "hubs")

    def table(df: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(spark, "labels")
        df.write.parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    path, labels = table(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).select(F.col("x").alias("node"), "label"))
    nodes = labels.count()
    for _ in range(most_rounds):
        near = spread_join(both, labels.withColumnRenamed("node", "y"), "y", degrees).groupBy("x").agg(F.min("label").alias("least"))
        step_path, step = table(labels.join(near, labels.node == near.x).select("node", F.col("label").alias("old"), F.least("label", "least").alias("mid")))
        shared = hot_keys(step.groupBy("mid").agg(F.count("*").alias("n")).select(F.col("mid").alias("key"), "n"), nodes)
        # Every label is a node, so the join loses none.
        far = spread_join(step, labels.select(F.col("node").alias("mid"), F.col("label").alias("far")), "mid", shared)
        new_path_, new = table(far.select("node", "old", F.least("mid", "far").alias("label")))
        delete_path(spark, path)
        delete_path(spark, step_path)
        path, labels = new_path_, new.select("node", "label")
        if new.where("label < old").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still change after {most_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
