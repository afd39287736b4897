"""Shards of near equal bytes by a histogram sort.

Rows are ordered by a key: the hash of the text above, the hash of the id below, so equal texts stand together. The keys
that part the shards (splitters) are found by counting: each round deals candidate keys over the intervals in which
splitters must lie, one pass over the narrow table of keys and sizes counts the exact bytes and rows below every
candidate, and the intervals shrink to the neighbours of the target. A splitter is done when its bytes are within the
tolerance; as long as that can be met between two texts, no group of equal texts is cut. Then the rows are exchanged
once, each straight to its place, and written as the shards' files.

A shard is several pieces, as many together as the session has shuffle partitions, so no shard passes through one task. A
group of copies larger than a piece is cut by its ids, and rows that agree in id and text as well, by shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import delete_path, new_path, partitions, text_or_empty, written_at

#: How far a shard's end may lie from its target, in parts of a shard; pieces inside a shard are less strict.
TOLERANCE, PIECE_TOLERANCE = 0.002, 0.05
#: Low bits of a key that belong to the id.
ID_BITS = 23
#: Candidates of a round, about; at least four for each open splitter.
PROBES = 1 << 14
LOWEST, BEYOND = -(1 << 63), 1 << 63
U = 1 << 20


class Splitter(NamedTuple):
    """Rows with a smaller key lie before it; of those with this very key the share ``part``. ``bytes_below`` and ``rows_below`` without that share."""

    key: int
    part: float
    bytes_below: int
    rows_below: int


def row_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none), plus 1."""
    return F.octet_length(F.coalesce(text.cast("string"), F.lit(""))).cast("long") + 1


def row_key(id_column: str, text_column: str) -> Column:
    low = (1 << ID_BITS) - 1
    return F.xxhash64(text_or_empty(text_column)).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.col(id_column)).bitwiseAND(F.lit(low)))


def below(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of ``keys`` (key, size) with a key under each probe; a task hands on one row for each gap between probes."""
    edges = np.array(probes, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            gap = np.searchsorted(edges, batch.column(0).to_numpy(), side="right")
            np.add.at(total, gap, batch.column(1).to_numpy())
            rows += np.bincount(gap, minlength=len(rows))
        there = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there]), pa.array(rows[there])], names=["gap", "size", "n"])

    found = keys.mapInArrow(count, "gap bigint, size bigint, n bigint").groupBy("gap").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    total, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in found.collect():
        total[r.gap], rows[r.gap] = r["size"], r.n
    return np.cumsum(total)[:-1], np.cumsum(rows)[:-1]


def probes_between(low: int, high: int, n: int) -> list[int]:
    """Up to n keys inside an open interval, evenly: ends of groups of texts while it holds several, else any."""
    step = 1 << ID_BITS
    unit = step if high - low > step else 1
    first, last = (low // unit + 1), -(-high // unit) - 1
    if last < first:
        return []
    n = min(n, last - first + 1)
    return sorted({(first + (last - first) * (2 * k + 1) // (2 * n)) * unit for k in range(n)})


def splitters(keys: DataFrame, targets: list[int], slack: list[int], total: int, rows: int) -> list[Splitter]:
    """For each target (bytes, ascending) the key that the bytes below come nearest to it, found by rounds of counting."""
    known = {LOWEST: (0, 0), BEYOND: (total, rows)}
    bounds = [(LOWEST, BEYOND)] * len(targets)
    done: list[Splitter | None] = [None] * len(targets)

    def settle(i: int) -> None:
        low, high = bounds[i]
        near = min((abs(known[k][0] - targets[i]), k) for k in (low, high))
        inside = known[high][1] - known[low][1]
        if near[0] <= slack[i] or inside <= 1 or (high - low == 1 and known[high][0] - known[low][0] <= 2 * slack[i]):
            done[i] = Splitter(near[1], 0.0, *known[near[1]])
        elif high - low == 1:  # rows that agree in id and text: a share of them goes to either side
            done[i] = Splitter(low, (targets[i] - known[low][0]) / (known[high][0] - known[low][0]), *known[low])

    for i in range(len(targets)):
        settle(i)
    while any(d is None for d in done):
        open_ = [i for i, d in enumerate(done) if d is None]
        each = max(4, PROBES // len(open_))
        probes = sorted({p for low, high in {bounds[i] for i in open_} for p in probes_between(low, high, min(each * sum(bounds[j] == (low, high) for j in open_), PROBES))})
        size_below, rows_below = below(keys, probes)
        known |= {p: (int(s), int(n)) for p, s, n in zip(probes, size_below, rows_below, strict=True)}
        order = sorted(known)
        sizes = np.array([known[k][0] for k in order])
        for i in open_:
            # The last key with no more bytes below than the target, and the first with more: neighbours among all that were counted.
            at = int(np.searchsorted(sizes, targets[i], side="right"))
            bounds[i] = (order[min(at, len(order) - 1) - 1], order[min(at, len(order) - 1)])
            settle(i)
        known = {k: known[k] for b in bounds for k in b} | {LOWEST: (0, 0), BEYOND: (total, rows)}
    return sorted(d for d in done if d is not None)


def piece_of(found: list[Splitter]) -> Column:
    """The number of splitters at or before a row's key (column ``__key``)."""
    edges = np.array([min(s.key, BEYOND - 1) for s in found], np.int64)
    shared = [s for s in found if s.part > 0]
    never = sum(s.key == BEYOND for s in found)

    @F.pandas_udf("int")
    def whole(key: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(edges, key.to_numpy(), side="right").clip(max=len(edges) - never)).astype(np.int32))

    @F.pandas_udf("int")
    def with_shares(key: pd.Series, lot: pd.Series) -> pd.Series:
        values, lots = key.to_numpy(), lot.to_numpy()
        at = np.searchsorted(edges, values, side="right").clip(max=len(edges) - never)
        for s in shared:
            at = at - ((values == s.key) & (lots < s.part))
        return pd.Series(at.astype(np.int32))

    if not shared:
        return whole("__key")
    lot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(U)) / U
    return with_shares(F.col("__key"), lot)


def shard_documents(df: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), tolerance: float = TOLERANCE) -> tuple[DataFrame, str]:
    """Deals all rows to shards of near equal bytes and writes them; the shards as a table, and the path of their files.

    Columns: id_column, text_column as they were, those in ``keep``, size (bytes of the text plus 1; null: 1), shard (0 to
    shards - 1) and slot (0, 1, ... in each shard, by key). The files lie in folders by shard. A shard's bytes differ from
    an even share by ``tolerance`` of it at either end, or by half a document where documents are larger. Equal
    texts stand side by side, and in one shard unless its end falls into a group that is larger than the tolerance. Null
    ids and repeated rows are rows like others. Fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    if clash := {"size", "shard", "slot"} & {id_column, text_column, *keep}:
        raise ValueError(f"columns of the result: {clash}")
    spark = df.sparkSession
    names = [id_column, text_column, *keep]
    plain = [f"__{i}" for i in range(len(names))]
    rows = df.select(*[F.col(c).alias(p) for c, p in zip(names, plain, strict=True)])
    rows = rows.withColumn("__size", row_size(F.col("__1"))).withColumn("__key", row_key("__0", "__1"))
    keys, keys_path = written_at(rows.select("__key", "__size"), "keys")
    total, n = keys.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    each = -(-partitions(spark) // shards)
    pieces = shards * each
    targets = [total * k // pieces for k in range(1, pieces)]
    slack = [int(total / shards * tolerance) if k % each == 0 else int(total / pieces * PIECE_TOLERANCE) for k in range(1, pieces)]
    found = splitters(keys, targets, slack, total, n)
    delete_path(spark, keys_path)
    dealt = rows.withColumn("__piece", piece_of(found)).withColumn("__shard", F.floor(F.col("__piece") / each).cast("int"))
    dealt = dealt.repartitionById(pieces, F.col("__piece")).sortWithinPartitions("__shard", "__piece", "__key", F.xxhash64("__0"), "__0")
    path = new_path(spark, "shards")
    out = dealt.withColumn("__at", F.monotonically_increasing_id())
    out.write.partitionBy("__shard").parquet(path)
    schema = out.select(*[c for c in out.columns if c != "__shard"], "__shard").schema
    files = spark.read.schema(schema).parquet(path)
    # A piece is one task's rows, numbered without a gap; pieces of a shard follow each other.
    counts = sorted(tuple(r) for r in files.groupBy("__shard", "__piece").agg(F.count("*"), F.min("__at"), F.max("__at")).collect())
    starts, before, last = [], 0, None
    for shard, piece, rows_, low, high in counts:
        if high - low + 1 != rows_:
            raise RuntimeError("a piece was written by several tasks")
        before = 0 if shard != last else before
        starts.append((piece, before - low))
        before, last = before + rows_, shard
    shifts = F.broadcast(spark.createDataFrame(starts, "__piece int, __shift bigint"))
    placed = files.join(shifts, "__piece")
    final = [F.col(p).alias(c) for c, p in zip(names, plain, strict=True)]
    return placed.select(*final, F.col("__size").alias("size"), F.col("__shard").alias("shard"), (F.col("__at") + F.col("__shift")).alias("slot")), path


def digests(sharded: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size, checksum of the text, law, shard, slot, and null for the shard of one more: this law gives it no meaning."""
    checksum = F.crc32(F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary"))
    return sharded.select(id_column, "size", checksum.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
