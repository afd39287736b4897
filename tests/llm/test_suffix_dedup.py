"""Removal of repeated windows against a brute-force version over all windows."""

import hashlib
import random
import time

import numpy as np

from weftline.llm import suffix_dedup as s
from weftline.llm.queries import op6_suffix_dedup


def brute(rows, length=50):
    least = {}
    data = [(-(1 << 63) if k is None else k, k, (t or "").encode()) for k, t in rows]
    for rank, _, b in data:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            least[w] = min(least.get(w, rank), rank)
    out = []
    for rank, key, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < rank:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = sorted((tuple(r) for r in op6_suffix_dedup(spark, small).collect()), key=str)
    assert found == brute(rows)
    assert sum(r[2] for r in found) > 1000


def test_awkward_rows(spark):
    rng = random.Random(3)
    phrase = "".join(rng.choice("abcdeé ") for _ in range(60))
    rows = [(5, "x" + phrase + "y"), (3, phrase), (5, phrase), (None, phrase[5:]), (9, None), (8, ""), (7, "z" * 400), (11, "z" * 49), (12, "z" * 50), (13, "ab" * 300), (14, "ab" * 26), (2, "ab" * 25 + "c")]
    rows += [(20 + i, "".join(rng.choice("ab") for _ in range(rng.randrange(300)))) for i in range(30)]
    rows += [(80 + i, phrase[i:] + phrase + "q" * i) for i in range(20)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, batch int, key int")
    for length in (50, 24):
        found = sorted((tuple(r) for r in s.digest_columns(s.remove_repeats(df, length=length, buckets=5)).collect()), key=str)
        assert found == brute(rows, length)
    assert s.remove_repeats(df.limit(0)).count() == 0


def test_digit_passes_find_equal_windows():
    rng = np.random.default_rng(4)
    windows = rng.integers(0, 2, (400, 11), dtype=np.uint8)
    ids = rng.integers(0, 1000, 400)
    expected = {}
    for w, i in zip(map(bytes, windows), ids.tolist(), strict=True):
        expected[w] = min(expected.get(w, i), i)
    assert s.repeated_windows(windows, ids).tolist() == [expected[bytes(w)] for w in windows]


def test_a_string_between_ever_different_neighbours(spark):
    """A line that a third of the documents have, each in other words: its windows at the edges are all different, and no task gets all of them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(12))
    line = " ".join(word() for _ in range(5))[:55]
    rows = [(k, f"{word()}{word()} {line}{word()} {word()}" if k % 3 == 0 else " ".join(word() for _ in range(12))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute(rows)
    find = lambda: sorted((tuple(r) for r in s.digest_columns(s.remove_repeats(df, buckets=6)).collect()), key=str)
    assert find() == expected
    texts = [(k, t.encode()) for k, t in rows]
    runs, parts, _, number = s._batch_anchors(texts, 50, 6, True)
    hottest = np.concatenate(parts)[number.argmax()]
    assert number.max() > 50
    one = s._Chosen(texts, runs, np.array([hottest]), np.zeros(0, np.uint64), 50, 6)
    two = s._Chosen(texts, runs, np.array([hottest]), np.array([hottest]), 50, 6)
    assert len(set(one.hash.tolist())) == 1 and len(set(two.hash.tolist())) > 50 and len(set(two.bucket.tolist())) == 6


def test_hot_anchors_change_nothing(spark, small):
    rows = [(r.doc_id, r.text[:3000]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for bound in (0, 3):
        found = sorted((tuple(r) for r in s.digest_columns(s.remove_repeats(df, buckets=4, hot_runs=bound)).collect()), key=str)
        assert found == brute(rows)


def test_work_does_not_grow_with_the_number_of_buckets():
    """There are as many buckets as batches, so looking at all runs for each bucket grew as the square of the input."""
    rng = np.random.default_rng(5)
    texts = [(k, rng.integers(97, 123, 4000, dtype=np.uint8).tobytes()) for k in range(500)]
    runs, parts, _, _ = s._batch_anchors(texts, 50, 40_000)
    c = s._Chosen(texts, runs, np.sort(np.concatenate(parts)), np.zeros(0, np.uint64), 50, 40_000)
    began = time.process_time()
    found = [c.of(b) for b in range(40_000)]
    assert time.process_time() - began < 1.5
    assert len(c.bytes) > 100_000 and sorted(np.concatenate(found).tolist()) == list(range(len(c.bytes)))
    for b in range(0, 40_000, 1000):
        assert found[b].tolist() == np.flatnonzero(c.bucket == b).tolist()


def test_spans_end_with_their_text():
    texts = [(1, b"ab" * 10), (s.NULL_ID, b""), (2, b"ab" * 10), (3, b""), (4, b"x")]
    places = np.array([0, 0, 2, 2]), np.array([2, 15, 0, 8]), np.array([2, 1, 1, 3])
    rows = s._without(texts, places, 5).to_pylist()
    assert [(r["key"], r["n_bytes"], r["kept"]) for r in rows] == [(1, 20, b"ab" + b"ababababab"[:7]), (None, 0, b""), (2, 20, b"bab" + b"babab"), (3, 0, b""), (4, 1, b"x")]
    assert [[(x["start"], x["end"]) for x in r["spans"]] for r in rows] == [[(2, 8), (15, 20)], [], [(0, 5), (8, 15)], [], []]
