"""Brute-force vector search in blocks: matrices in tasks, the best of each block, merged by Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import partitions

#: Vectors of a block of queries and of the base: a product of two blocks has 64 MB at most.
QUERIES, BASE = 1024, 8192


def blocks(df: DataFrame, id_column: str, vec: str, size: int, name: str, spread: int = 1) -> tuple[DataFrame, int]:
    """``name`` (the block's number), ids and matrix (rows of doubles) of about ``size`` vectors each, and how many numbers there are, ``spread`` at least. Null vectors are left out."""
    known = df.where(F.col(vec).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    n = known.count()
    numbers = max(1, min(spread, n), math.ceil(n / size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            ids, rows = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([ids.tobytes()]), pa.array([np.ascontiguousarray(rows).tobytes()])], names=["number", "ids", "matrix"])

        for batch in batches:
            if not batch.num_rows:
                continue
            number, ids, vecs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            width = np.diff(vecs.offsets.to_numpy())
            if (width != width[0]).any():
                raise ValueError("vectors of different length")
            rows = vecs.flatten().to_numpy().reshape(len(ids), width[0])
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and (held[0][0] != number[a] or sum(len(h[1]) for h in held) + b - a > 2 * size):
                    yield out()
                    held.clear()
                held.append((int(number[a]), ids[a:b], rows[a:b]))
        if held:
            yield out()

    numbered = known.select(F.pmod(F.xxhash64("id"), F.lit(numbers)).cast("int").alias("number"), "id", "vec")
    dealt = numbered.repartition(min(numbers, partitions(df.sparkSession)), "number").sortWithinPartitions("number")
    return dealt.mapInArrow(pack, "number int, ids binary, matrix binary").withColumnsRenamed({"number": name, "ids": f"{name}_ids", "matrix": f"{name}_matrix"}), numbers


def _best_of(q: np.ndarray, qids: np.ndarray, b: np.ndarray, bids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and cosine (to six places) of the ``k`` best of a block for each query; equal scores by id."""
    scale = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
    score = np.round(np.divide(q @ b.T, scale, out=np.zeros_like(scale), where=scale > 0), 6)
    score[(qids[:, None] == bids[None, :]) | (score < least)] = -np.inf
    if score.shape[1] > k:
        floor = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
    else:
        row, col = np.nonzero(score > -np.inf)
    order = np.lexsort((bids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], bids[col[keep]], score[row[keep], col[keep]]


def top_similar(queries: DataFrame, base: DataFrame, k: int, least: float = -2.0) -> DataFrame:
    """For each query (qid, qvec, ...) the ``k`` most similar vectors (id, vec, ...) by cosine, at ``least`` or more, with score and rank.

    Ids are unique integers; a query doesn't find its own id; a zero vector has similarity 0; null vectors neither ask nor
    are found. Both sides may have any size: blocks of queries meet blocks of the base in numpy products, each block hands on ``k``
    rows a query, and those of all blocks are ranked by Spark.
    """
    asked, n_asked = blocks(queries, "qid", "qvec", QUERIES, "q")
    there, n_there = blocks(base, "id", "vec", BASE, "b", partitions(base.sparkSession))
    # Every block of queries goes to every block of the base: the comparing is exact, and the smaller blocks travel.
    met = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_there - 1)))).join(there, "b")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qids, q, bids, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                qids, bids = np.frombuffer(qids, np.int64), np.frombuffer(bids, np.int64)
                row, ids, score = _best_of(np.frombuffer(q).reshape(len(qids), -1), qids, np.frombuffer(b).reshape(len(bids), -1), bids, k, least)
                yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids), pa.array(score)], names=["qid", "id", "score"])

    found = met.select("q_ids", "q_matrix", "b_ids", "b_matrix").mapInArrow(best, "qid bigint, id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    more_q, more_b = ([c for c in df.columns if c not in own] for df, own in ((queries, ("qid", "qvec")), (base, ("id", "vec"))))
    out = ranked.join(queries.select(F.col("qid").cast("long").alias("qid"), *more_q), "qid") if more_q else ranked
    return out.join(base.select(F.col("id").cast("long").alias("id"), *more_b), "id") if more_b else out


def rescore(hits: DataFrame, weight: str) -> DataFrame:
    """Scores times a weight (1 where it isn't positive), ranked anew within the hits."""
    w = F.when(F.coalesce(F.col(weight), F.lit(0.0)) > 0, F.col(weight)).otherwise(1.0)
    out = hits.withColumn("score", F.round(F.col("score") * w, 6))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))


def penalise(hits: DataFrame, same: Column, keys: list[str], factor: float = 0.5) -> DataFrame:
    """Hits of another domain count ``factor``; the best of each query and key stays."""
    out = hits.withColumn("score", F.round(F.when(same, F.col("score")).otherwise(F.col("score") * factor), 6))
    return out.withColumn("r", F.row_number().over(Window.partitionBy("qid", *keys).orderBy(F.desc("score"), "id"))).where("r = 1").drop("r")
