"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import spelling
from weftline.llm.queries import op13_spelling


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def plain(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out = {}
    for w, n in words.items():
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [form, None, n, len(others), None if form is None else words[form]]
    for w in out:
        at = w
        while out[at][0] is not None:
            at = out[at][0]
        out[w][1] = at
    return {(w, *v) for w, v in out.items()}


def rows_of(found):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    expected = plain(rows)
    assert any(r[1] for r in expected) and any(r[4] > 3 for r in expected)
    assert rows_of(op13_spelling(spark, small)) == expected


def test_awkward_rows(spark):
    words = {"bookkeeper": 400, "bokkeeper": 70, "bookeeper": 12, "bookkeepers": 9, "bookkeepêr": 6, "abcdef": 30, "abcdeg": 30, "abcdez": 6, "ÀÀÀÀÀÀ": 8, "÷×÷×÷×": 5, "aaaaaaa": 60, "aaaaaa": 300, "aaaaaaaa": 11, "short": 99, "Fourtimes": 4, "x" * 3000: 50, "x" * 2999: 8}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    rows = [(1, text), (2, None), (3, ""), (None, "Bookkeeper BOOKKEEPER abcdef-abcdef"), (4, "bookkeeper"), (4, "bookkeeper"), (4, "ſſſſſſ ıııııı")]
    df = spark.createDataFrame([(k, t, "w", 1, "r") for k, t in rows], "doc_id bigint, text string, word string, n int, root string")
    assert rows_of(spelling.spelling_variants(df)) == plain(rows)
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_many_slips_chain(spark):
    """Slips of a common word, of many documents, lead back to it."""
    rows = [(i, "understanding misunderstand " * 6) for i in range(4000)]
    found = rows_of(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert found == plain(rows)
    assert sum(r[2] == "understanding" for r in found) > 3


def test_keys_of_a_length():
    words = ["letter", "better", "leeter"]
    keys, number, kind = spelling.deletion_keys(words)
    meet = {}
    for key, w, k in zip(keys.tolist(), number.tolist(), kind.tolist()):
        meet.setdefault(key, []).append((w, k))
    assert sorted(v for v in meet.values() if len(v) > 1 and {w for w, _ in v} == {0, 1}) == [[(0, 0), (1, 0)], [(0, 6), (1, 6)]]
    short = spelling.deletion_keys(["leter"])
    assert short[0][0] in set(keys.tolist())
    assert len(set(zip(number[kind >= 6].tolist(), kind[kind >= 6].tolist()))) == 5 + 5 + 5


def test_equal_hashes_join_nothing():
    """Rows of one key whose strings differ are separate groups."""
    found = list(spelling.group_results([("abcdef", 9, 0), ("xbcdef", 50, 0), ("qrstuv", 7, 3), ("bcdef", 99, spelling.FULL), ("abcdef", 9, 6)]))
    assert sorted(found) == [("abcdef", 1, 50, "xbcdef"), ("abcdef", 1, 99, "bcdef"), ("bcdef", 1, 9, "abcdef"), ("xbcdef", 1, 9, "abcdef")]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_groups_across_batches(spark, parts):
    """A key's rows may lie in several Arrow batches."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abc"), 6)) for _ in range(300)}
    rows = [(w, int(n)) for w, n in zip(sorted(words), rng.integers(5, 400, len(words)))]
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = {r.word: (r.n_near, r.form) for r in spelling.near_words(spark.createDataFrame(rows, "word string, n bigint")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    counts = dict(rows)
    for w, n in rows:
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        assert found[w] == (len(others), best if best is not None and counts[best] >= 5 * n else None)
