"""SimHash components against a brute-force version over all pairs."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weftline.llm import simhash
from weftline.llm.queries import op10_simhash

AWKWARD = "doc_id bigint, text string, lanes string, node string"


def brute(rows, words=4, radius=4):
    prints = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
        prints.setdefault(key, []).append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    flat = [(k, p) for k, ps in prints.items() for p in ps]
    label = {p: min(k for k, q in flat if q == p) for _, p in flat}
    while True:
        new = {p: min(label[q] for q in label if (p ^ q).bit_count() <= radius) for p in label}
        if new == label:
            return sorted((k, f"{p:016x}", label[p]) for k, p in flat)
        label = new


def test_documents_match_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = sorted(tuple(r) for r in op10_simhash(spark, small).select("doc_id", "fingerprint", "component_id").collect())
    assert found == brute(rows)


def test_nulls_empty_ties_repeats_and_clashing_columns(spark):
    rows = [(5, None), (7, ""), (2, "a b c d e"), (2, "a b c d e"), (9, "A B C D E"), (4, "x"), (8, " \t\n"), (3, "long " * 5000)]
    df = spark.createDataFrame([(k, t, "z", None) for k, t in rows], AWKWARD)
    found = sorted(tuple(r) for r in simhash.simhash_components(df).collect())
    assert found == brute(rows)
    none = simhash.simhash_components(spark.createDataFrame([(None, "a b c d", "z", None)], AWKWARD)).collect()
    assert [(r.doc_id, r.component_id) for r in none] == [(None, None)]
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_cut_buckets_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40)
    prints = [int(b) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for b in base for _ in range(8)]
    df = spark.createDataFrame([(i, [p], 1 + i % 50) for i, p in enumerate(prints)], "doc_id bigint, lanes array<bigint>, n_shingles bigint")
    for ratio in (0.0, 0.8):
        one = sorted(map(str, simhash.near_components(df, "doc_id", 4, 1, ratio).collect()))
        monkeypatch.setattr(simhash, "PART", 3)
        monkeypatch.setattr(simhash, "TILE", 4)
        assert sorted(map(str, simhash.near_components(df, "doc_id", 4, 1, ratio).collect())) == one
        monkeypatch.undo()
    labels = {r.doc_id: r.component_id for r in simhash.near_components(df, "doc_id", 4, 1, 0.8).collect()}
    expected = {i: i for i in range(len(prints))}
    linked = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4 and min(1 + i % 50, 1 + j % 50) >= 0.8 * max(1 + i % 50, 1 + j % 50)]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(expected[i], expected[j])
            if expected[i] != low or expected[j] != low:
                expected[i] = expected[j] = low
                changed = True
    assert labels == expected


def test_near_copies_of_five_word_shingles(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    text = [str(x) for x in rng.choice(words, 400)]
    near = list(text)
    for k in (50, 150, 250):
        near[k] = "changed"
    other = [str(x) for x in rng.choice(words, 400)]
    df = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(other))], "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).select("doc_id", F.col("component_id")).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def exact(rows, similarity=0.8):
    sets = {k: shingles(t) for k, t in rows}
    label = {k: k for k in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    while True:
        new = dict(label)
        for a, b in linked:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def components_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}


def test_links_are_those_of_exact_similarity(spark, small, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for k in range(60):  # pairs on both sides of 0.8, by edits apart from each other in long and short texts
        text = [f"v{x}" for x in rng.integers(0, 10**6, int(rng.choice([8, 20, 100, 400])))]
        near = list(text)
        for at in range(3, max(4, int(len(text) * rng.uniform(0.0, 0.06)) * 16), 16):
            near[at % len(text)] = f"new{k}.{at}"
        rows += [(10**6 + 2 * k, " ".join(text)), (10**6 + 2 * k + 1, " ".join(near))]
    eight = "a b c d e f g h"
    rows += [(2 * 10**6, eight), (2 * 10**6 + 1, eight + " i"), (2 * 10**6 + 2, "k l m n o p q"), (2 * 10**6 + 3, "k l m n o p q r")]  # 4 of 5: linked; 3 of 4: not
    expected = exact(rows)
    pairs = [expected[10**6 + 2 * k + 1] == 10**6 + 2 * k for k in range(60)]
    assert any(pairs) and not all(pairs) and expected[2 * 10**6 + 1] == 2 * 10**6 and expected[2 * 10**6 + 3] == 2 * 10**6 + 3
    assert components_of(spark, rows) == expected
    monkeypatch.setattr(simhash, "COMMON", 1)  # another order of shingles
    assert components_of(spark, rows) == expected


def test_chains_and_one_prefix_shared_by_many(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
    rows = []
    for k in range(40):  # copies that differ in k passages, in turn: neighbours link, ends don't
        text = list(base)
        for at in range(k):
            text[at * 5] = f"e{at}"
        rows.append((k, " ".join(text)))
    assert components_of(spark, rows) == exact(rows)


def test_repeats_of_passages_leave_similarity_as_it_is(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(20):  # a passage repeated 20 times more adds four shingles to a hundred; once and 20 times more have equal sets
        words = [f"w{x}" for x in rng.integers(0, 10**6, 104)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words + words[:54] + words[:4])), (3 * k + 2, " ".join(words + words[:54] * 20))]
    expected = exact(rows)
    assert expected == {k: k - k % 3 for k in range(60)}
    assert components_of(spark, rows) == expected
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = {r.doc_id: (r.lanes, r.n_shingles) for r in simhash.fingerprints(df, words=5, lanes=4).collect()}
    assert all(prints[k] == prints[k + 1] for k in range(1, 60, 3))


def test_tiles_are_skipped_by_population_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    prints = np.unique(np.array([simhash.majority(simhash.shingle_hashes(r.text or "", 4)) for r in docs], np.uint64))
    rng = np.random.default_rng(6)
    prints = np.unique(np.concatenate([prints, np.bitwise_xor.outer(prints, np.uint64(1) << rng.integers(0, 64, 4).astype(np.uint64)).ravel()]))
    tally = [0, 0]
    roots = simhash.tile_links(prints[:, None], np.zeros(len(prints), np.int64), False, 4, None, 0.0, tally)
    n = -(-len(prints) // simhash.TILE)
    assert tally[0] == n * (n + 1) // 2 and tally[1] >= 0.2 * tally[0]
    links = [(i, j) for i in range(0, len(prints), 7) for j in range(len(prints)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 4]
    assert len(links) > 500 and all(roots[i] == roots[j] for i, j in links)


def test_bands_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60)
    flip = lambda b, k: int(b) ^ sum(1 << int(i) for i in rng.choice(63, k, replace=False))
    prints = [p for b in base for p in (int(b), flip(b, 4), flip(b, 3), flip(b, 9))]
    df = spark.createDataFrame([(i, [p], 1) for i, p in enumerate(prints)], "doc_id bigint, lanes array<bigint>, n_shingles bigint")
    one = sorted(map(str, simhash.near_components(df, "doc_id", 4).collect()))
    for rows in (1, 40):
        monkeypatch.setattr(simhash, "ROWS", rows)
        assert sorted(map(str, simhash.near_components(df, "doc_id", 4).collect())) == one


def test_a_fingerprint_of_a_third_of_all_rows(spark):
    rows = [(k, "" if k % 3 else f"text number {k} of some words") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in simhash.simhash_components(df).collect()) == brute(rows)


def test_near_duplicates_of_a_thousand_documents_are_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = exact(rows)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == expected
    assert sum(k != v for k, v in expected.items()) > 20


def test_sketches_differ_in_no_more_bits_than_sets(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n in (0, 1, 50, 400, 500, 520, 1030, 5000):
        for share in (0.5, 0.9, 0.99):
            a = np.unique(rng.integers(0, 1 << 63, n))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(0, 1 << 63, n // 20)]))
            rows.append((simhash.parity(a), simhash.parity(b), len(a), len(b), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, na int, nb int, apart int")
    for similarity in (0.3, 0.8, 0.95):
        least = (1 - similarity) / (1 + similarity)
        found = df.withColumn("may", simhash.may_be_similar("a", "b", F.col("na"), F.col("nb"), similarity)).collect()
        assert all(r.may for r in found if r.apart <= least * (r.na + r.nb))
        assert similarity < 0.8 or any(not r.may for r in found)
    assert simhash.parity(np.zeros(0, np.int64)) == [0] * simhash.SKETCH
    assert {len(r[0]) for r in rows} == {8, 16, 32, 128}


def test_near_duplicates_come_from_fingerprints_first(spark, monkeypatch):
    rng = np.random.default_rng(12)
    text = [f"w{x}" for x in rng.integers(0, 10**6, 4000)]
    near = [*text[:2000], "other", *text[2001:]]
    rows = [(5, " ".join(text)), (7, " ".join(near)), (9, " ".join(reversed(text))), (11, "")]
    groups = simhash.token_groups
    monkeypatch.setattr(simhash, "token_groups", lambda *given: groups(*given).where("false"))  # what fingerprints find alone
    assert components_of(spark, rows) == {5: 5, 7: 5, 9: 9, 11: 11}
    monkeypatch.setattr(simhash, "near_components", lambda prints, key, radius: prints.select(key, F.lit(5).cast("long").alias("component_id")))
    assert components_of(spark, rows) == {5: 5, 7: 5, 9: 9, 11: 11}  # an exact check follows
