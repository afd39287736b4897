"""Line dedup against a brute-force version, and the shift resistance of its chunks."""

from collections import Counter

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import common
from weftline.llm.line_dedup import LEAST_LINES, chunkings, chunks, line_dedup, line_runs
from weftline.llm.queries import op7_line_dedup


def brute(rows):
    seen, out = {}, []
    order = sorted({(k is not None, k or 0, t) for k, t in rows if t is not None})
    for known, key, text in order:
        lines = text.split("\n")
        for a, b in chunks(text):
            seen.setdefault("\n".join(lines[a:b]), []).append((known, key, text, a))
    for key, text in rows:
        if text is None:
            out.append((key, None, 0, 0))
            continue
        lines, kept = text.split("\n"), []
        for a, b in chunks(text):
            chunk = "\n".join(lines[a:b])
            places = seen[chunk]
            first = places[0]
            here = (key is not None, key or 0, text, a)
            if b - a < LEAST_LINES or "\n" not in text or not any(c.isalnum() for c in chunk) or here == first:
                kept += lines[a:b]
        out.append((key, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def brute_levels(rows):
    """Of both levels: a chunk goes where an equal one stood before; of overlapping equal chunks of a text the first stays whole."""
    first = {}
    for known, key, text in sorted({(k is not None, k or 0, t) for k, t in rows if t is not None}):
        lines = text.split("\n")
        for n, (a, b) in enumerate(chunkings(text)):
            first.setdefault("\n".join(lines[a:b]), (known, key, text, n))
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, None, 0, 0))
            continue
        lines, places = text.split("\n"), chunkings(text)
        bodies = ["\n".join(lines[a:b]) for a, b in places]
        gone = {n for n, body in enumerate(bodies) if places[n][1] - places[n][0] > 1 and any(c.isalnum() for c in body) and first[body] != (key is not None, key or 0, text, n)}
        drop = set()
        for n in gone:
            other = bodies.index(bodies[n])
            drop |= set(range(*places[n])) - (set() if other in gone else set(range(*places[other])))
        kept = [line for i, line in enumerate(lines) if i not in drop]
        out.append((key, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted((tuple(r) for r in op7_line_dedup(spark, small).collect()), key=str)
    assert found == brute_levels(rows)
    alone = sorted((tuple(r) for r in line_dedup(docs, cut=chunks).collect()), key=str)
    assert alone == brute(rows)
    assert sum(r[3] for r in found) > sum(r[3] for r in alone) > 0
    left, owed = runs_left(rows, [(r[0], r[1]) for r in found])
    assert owed > 0 and left == []


def test_awkward_rows(spark):
    shared = "\n".join(f"line {i}" for i in range(40))
    rows = [(4, "intro\n" + shared), (2, shared), (9, None), (7, ""), (2, shared), (None, shared + "\nend"), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (8, "x\n" * 3000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, first int")
    found = sorted((tuple(r) for r in line_dedup(df, cut=chunks).collect()), key=str)
    assert found == brute(rows)
    assert sorted((tuple(r) for r in line_dedup(df).collect()), key=str) == brute_levels(rows)
    kept = line_dedup(df, keep=("first",))
    assert kept.columns == ["doc_id", "text", "n_lines", "n_removed", "first"] and kept.count() == len(rows)
    assert line_dedup(df.limit(0)).count() == 0


def test_chunks_resist_shifts():
    lines = [f"line {i}" for i in range(300)]
    one = {"\n".join(lines[a:b]) for a, b in chunks("\n".join(lines))}
    two = {"\n".join((["new"] + lines)[a:b]) for a, b in chunks("\n".join(["new", *lines]))}
    assert len(one & two) >= 0.9 * len(one)


def runs_left(rows, found):
    """(id, line) of lines in a run of two lines that stood in an earlier document and still stand, and how many such lines there were."""
    seen, left, owed = set(), [], 0
    after = {k: Counter(text.split("\n")) for k, text in found if text is not None}
    for key, text in sorted((k, t) for k, t in rows if t is not None):
        lines = text.split("\n")
        pairs = [p for p in zip(lines, lines[1:]) if any(c.isalnum() for line in p for c in line)]
        covered = {i for i, p in enumerate(zip(lines, lines[1:])) if p in seen}
        covered |= {i + 1 for i in covered}
        owed += len(covered)
        allowed = Counter(line for i, line in enumerate(lines) if i not in covered)
        left += [(key, line) for line, n in after[key].items() if n > allowed[line] and any(c.isalnum() for c in line)]
        seen |= set(pairs)
    return left, owed


def test_pipeline_stage_removes_every_repeated_run(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(10**6 + k, "\n".join([f"a{k}.{i}" for i in range(k)] + [f"shared {i}" for i in range(n)] + ["", "", ""] * (k % 2) + [f"b{k}.{i}" for i in range(5)])) for k, n in enumerate((5, 2, 3, 4, 5, 2, 3))]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = [(r.doc_id, r.text) for r in corpus_pipeline.line_stage(spark, df, small).collect()]
    left, owed = runs_left(rows, found)
    assert owed > 0 and left == []
    # The first place of every line stays.
    assert {line for _, t in rows if t for line in t.split("\n")} == {line for _, t in found if t for line in t.split("\n")}
    assert runs_left(rows, [(r[0], r[1]) for r in brute(rows)])[0]  # chunks alone leave some


def test_runs_of_awkward_texts(spark):
    df = spark.createDataFrame([(1, "x\nx\nx\nx"), (2, "y\nx\nx"), (3, "x\nx\nz")], "doc_id bigint, text string")
    assert sorted(tuple(r)[:2] for r in line_dedup(df, cut=line_runs).collect()) == [(1, "x\nx"), (2, "y"), (3, "z")]
    assert line_runs("") == line_runs("\n\n") == line_runs("one") == []
    assert line_runs("a\nb\n\n\nc") == [(0, 2), (1, 3), (1, 5), (3, 5)]


def own_chunks(lines):
    """Boundaries by the definition, worked out anew: after a line (the second of its chunk at least) where the hash of it and the one before has two zero bits."""
    out, start = [], 0
    h = [xxhash.xxh64(x.encode()).intdigest() for x in lines]
    for i, x in enumerate(h):
        both = x if i == start else (h[i - 1] * 1099511628211 + x) % 2**64
        both ^= both >> 29
        if i > start and both % 4 == 0:
            out.append(lines[start : i + 1])
            start = i + 1
    return [*out, lines[start:]] if start < len(lines) else out


def test_documents_against_an_independent_chunker(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    seen, expected = set(), {}
    for key, text in rows:
        kept = []
        for chunk in own_chunks(text.split("\n")):
            body = "\n".join(chunk)
            if len(chunk) < 2 or not any(c.isalnum() for c in body) or body not in seen:
                kept += chunk
            if len(chunk) >= 2:
                seen.add(body)
        expected[key] = "\n".join(kept)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert {r.doc_id: r.text for r in line_dedup(docs, cut=chunks).collect()} == expected


def test_a_chunk_of_a_third_of_all_documents(spark):
    shared = "\n".join(f"shared line {i}" for i in range(12))
    rows = [(k, f"{shared}\nown {k}\nand {k}" if k % 3 == 0 else f"a {k}\nb {k}\nc {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in line_dedup(df).collect()), key=str) == brute_levels(rows)
    assert sorted((tuple(r) for r in line_dedup(df, cut=chunks).collect()), key=str) == brute(rows)
    found = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("hash"), F.col("id").alias("row"))
    small = found.groupBy("hash").agg(F.count("*").alias("n"))
    hot = common.hot_keys(small.select(F.col("hash").alias("key"), "n"))
    assert [(r.key, r.pieces > 8) for r in hot.collect()] == [(7, True)]
    joined = common.spread_join(found, small.select("hash", "n"), "hash", hot)
    assert joined.count() == 3000 and joined.where("hash = 7 and n = 1001").count() == 1001
