"""Sharding: every row once, sizes near equal, slots without a gap, groups of equal texts together."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from weftline.llm import sharding
from weftline.llm.queries import op12_sharding


def by_shard(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    return out


def check_slots(rows):
    for members in by_shard(rows).values():
        assert sorted(r.slot for r in members) == list(range(len(members)))


def test_documents(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op12_sharding(spark, small).collect()
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    assert all(r["size"] == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in rows)
    check_slots(rows)
    total, longest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for shard in range(8):
        assert abs(sum(r["size"] for r in rows if r["shard"] == shard) - total / 8) <= total / 8 * 2 * sharding.TOLERANCE + longest
    again = {r.doc_id: (r["shard"], r.slot) for r in op12_sharding(spark, small).collect()}
    assert again == {r.doc_id: (r["shard"], r.slot) for r in rows}


def test_sizes_are_near_equal_and_groups_stay_together(spark):
    random.seed(3)
    texts = [f"text {i} " * random.randint(1, 60) for i in range(4000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, texts[i % 400]) for i in range(1200)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, tolerance=0.01)[0].collect()
    total = sum(r["size"] for r in found)
    sizes = [sum(r["size"] for r in m) for m in by_shard(found).values()]
    assert len(sizes) == 5 and all(abs(s - total / 5) <= 0.02 * total / 5 for s in sizes)
    shards = defaultdict(set)
    for r in found:
        shards[r.text].add(r["shard"])
    assert max(len(s) for s in shards.values()) == 1
    check_slots(found)


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, "the same text over and over again") for i in range(3000)] + [(5000 + i, f"{i} other words " * 3) for i in range(6000)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 8)[0].collect()
    total = sum(r["size"] for r in found)
    assert len(found) == 9000 and all(abs(sum(r["size"] for r in m) - total / 8) <= 0.006 * total / 8 for m in by_shard(found).values())
    check_slots(found)


def test_a_third_of_all_rows_is_one_row(spark):
    rows = [(7, "one row again and again")] * 6000 + [(5000 + i, f"{i} other words " * 3) for i in range(6000)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 8)[0].collect()
    total = sum(r["size"] for r in found)
    assert sorted((r.doc_id, r.text) for r in found) == sorted(rows)
    assert all(abs(sum(r["size"] for r in m) - total / 8) <= 0.1 * total / 8 for m in by_shard(found).values())
    check_slots(found)


def test_awkward_rows(spark):
    rows = [(None, "no id", 1), (None, None, 2), (3, None, 3), (3, "", 4), (3, "x" * 400_000, 5), (4, "é" * 10, 6), (4, "é" * 10, 6)]
    df = spark.createDataFrame([(*r, "__key") for r in rows], "doc_id bigint, text string, __size int, __key string")
    found = sharding.shard_documents(df, 3, keep=("__size",))[0]
    assert found.columns == ["doc_id", "text", "__size", "size", "shard", "slot"]
    got = found.collect()
    assert sorted(map(str, [(r.doc_id, r.text, r["__size"]) for r in got])) == sorted(map(str, rows))
    assert {r["size"] for r in got} == {1, 6, 21, 400_001}
    check_slots(got)
    assert sharding.shard_documents(df.limit(0), 3)[0].collect() == []
    assert [r.slot for r in sharding.shard_documents(df, 1)[0].sort("slot").collect()] == list(range(7))


def test_files_of_a_shard(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    sharded, path = sharding.shard_documents(df, 4)
    for shard in range(4):
        assert spark.read.parquet(f"{path}/__shard={shard}").count() == sharded.where(f"shard = {shard}").count() > 0


def test_splitters_are_the_nearest_ends(spark):
    rng = np.random.default_rng(8)
    keys, sizes = np.unique(rng.integers(-(2**62), 2**62, 300)), rng.integers(1, 900, 300)
    df = spark.createDataFrame(list(zip(keys.tolist(), sizes[: len(keys)].tolist())), "key bigint, size bigint")
    total = int(sizes[: len(keys)].sum())
    targets = [total * k // 7 for k in range(1, 7)]
    ends = [0, *np.cumsum(sizes[: len(keys)]).tolist()]
    for s, t in zip(sharding.splitters(df, targets, [0] * 6, total, len(keys)), targets):
        assert abs(s.bytes_below - t) == min(abs(e - t) for e in ends) and s.part == 0
        assert s.bytes_below == int(sizes[: len(keys)][keys < s.key].sum()) and s.rows_below == int((keys < s.key).sum())
