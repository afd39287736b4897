"""MinHash fingerprints: edited texts by hand, likeness against exact Jaccard similarity, and a plan without Python."""

import hashlib
import math
import struct

import xxhash
from pyspark.sql import functions as F

from weftline.llm import minhash
from weftline.llm.queries import op3_minhash


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (key, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        out[key] = (text[: len(text) - cut] + following[:cut], following)
    return out


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = op3_minhash(spark, small)
    assert not any(x in found._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    found = found.collect()
    expected, texts = edits(rows), dict(rows)
    assert len(found) == len(rows) == len({r.doc_id for r in found})
    errors = []
    for r in found:
        edited, following = expected[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(texts[r.doc_id]), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(texts[r.doc_id], edited), r.near_next - jaccard(texts[r.doc_id], following)]
        assert len(r.fingerprint) == minhash.BINS and 0 <= r.near_next <= 1
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.05 and max(map(abs, errors)) < 0.2
    by_text = {}
    for r in found:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_awkward_rows(spark):
    rows = [(None, "first a b c d e f g"), (2, None), (3, ""), (4, "one"), (5, "é" * 9), (7, "w " * 9000)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, bucket int, doc string")
    found = {r.doc_id: r for r in minhash.edited_fingerprints(df).collect()}
    for key, (edited, _) in edits(rows).items():
        assert found[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), key
    assert found[2].fingerprint == "" and found[2].near_next == 1 and found[3].near_next == 0
    same = spark.createDataFrame([(1, "a b c d e f")] * 5, "doc_id bigint, text string")
    assert [(r.near_edited, r.near_next) for r in minhash.edited_fingerprints(same).collect()] == [(0.0, 1.0)] * 5
    only = minhash.edited_fingerprints(df.where("doc_id = 4")).collect()
    assert [r.near_next for r in only] == [1.0]
    assert minhash.edited_fingerprints(df.limit(0)).count() == 0


def test_likeness_is_corrected_for_chance(spark):
    a, b = F.array_repeat(F.lit(0), 256), F.concat(F.array_repeat(F.lit(0), 16), F.array_repeat(F.lit(1), 240))
    found = spark.range(1).select(minhash.likeness(a, a).alias("same"), minhash.likeness(a, b).alias("chance"), minhash.fingerprint(b).alias("hex")).first()
    assert found.same == 1.0 and found.chance == 0.0 and found.hex == "0" * 16 + "1" * 240


def test_bins_are_the_least_values(spark):
    df = spark.createDataFrame([(1, [(0, 5), (63, 7), (64, 9), (255, 11)])], "k int, p array<struct<bin:int,value:bigint>>")
    masks = [F.lit(v).cast("long") for v in (1 | -(1 << 63), 1, 0, -(1 << 63))]
    found = df.select(minhash.filled(masks, F.col("p.value")).alias("x"), minhash.densified(minhash.filled(masks, F.col("p.value"))).alias("d")).first()
    assert {i: v for i, v in enumerate(found.x) if v is not None} == {0: 5, 63: 7, 64: 9, 255: 11}
    assert set(found.d) <= {5, 7, 9, 11} and len(found.d) == 256 and found.d[63] == 7
    probes = spark.range(256).select(F.col("id").cast("int").alias("b")).select(F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda j: minhash._probe(F.col("b"), j)))).alias("n"))
    assert {r.n for r in probes.collect()} == {256}


def own_digits(text):
    """Digits by the definition, in plain Python with another implementation of the hash."""
    signed = lambda x: x - (x >> 63 << 64)
    word_hash = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    words = [word_hash(w) for w in text.lower().split()]
    if not words:
        return ""
    bins = {}
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), h)
        b, value = h % 256, h >> 9
        bins[b] = min(bins.get(b, b << 55 | value), b << 55 | value)  # the value goes with its bin
    out = []
    for b in range(256):
        start, step = (b * 40503 + 12345) >> 5, (b * 48271 + 54321) >> 6 | 1
        asked = [b, *((start % 256 + step % 256 * j) % 256 for j in range(256))]
        v = next(bins[x] for x in asked if x in bins)
        digit = xxhash.xxh64_intdigest(struct.pack("<i", b), xxhash.xxh64_intdigest(struct.pack("<q", signed(v)), 42))
        out.append("0123456789abcdef"[digit % 16])
    return "".join(out)


def test_digits_are_those_of_an_independent_computation(spark, small):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = op3_minhash(spark, small).collect()
    expected = edits(sorted(rows.items()))
    for r in found[:60]:
        assert r.fingerprint == own_digits(rows[r.doc_id]) and r.edited_fingerprint == own_digits(expected[r.doc_id][0])


def test_a_third_of_all_rows_without_an_id(spark):
    rows = [(None if k % 3 == 0 else k // 2, f"text {k} of a few words and more {k * k}" if k % 7 else "one text of many rows") for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = lambda x: x - (x >> 63 << 64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    expected = []
    for (key, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(text) // 4
        expected.append((key, len(text), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()))
    found = [(r.doc_id, r.n_chars, r.edited_sha256) for r in minhash.edited_fingerprints(df).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    buckets = minhash.in_order(df, "doc_id", "text").where("extra = 0 and doc is null").groupBy("bucket").count().collect()
    assert len(buckets) > 4 and max(r["count"] for r in buckets) < 40
