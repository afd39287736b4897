"""The similarity join against all pairs, and how few of them are compared."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftline import session
from weftline.functions import text
from weftline.operators import front, similarity


def score(a, b, contained=True):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if contained and (a in b or b in a):
        return min(len(a), len(b)) / max(len(a), len(b))
    return SequenceMatcher(None, a, b).ratio()


def words(rng, n):
    base = ["visit date", "subject identifier", "adverse event term", "systolic pressure", "体重变化", "lab test name", "medication", "start", "aaaa", "weight kg"]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "x", "e", " ", "é"])
        out.append("".join(w) + rng.choice(["", "", " 2", " code"]))
    return out


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9, 1.0])
@pytest.mark.parametrize("contained", [True, False])
def test_equal_to_all_pairs(spark, least, contained):
    rng = random.Random(int(least * 100))
    left = [(rng.choice(["t", "u", None]), 1, w) for w in words(rng, 150)] + [("t", 1, ""), ("t", 1, None), ("t", 1, "y" * 300)]
    right = [(rng.choice(["t", "u", None]), 1, w) for w in words(rng, 150)] + [("t", 1, ""), ("u", 1, None), ("t", 1, "y" * 290 + "z" * 10)]
    one, two = spark.createDataFrame(left, "block string, k int, a string"), spark.createDataFrame(right, "block string, k int, b string")
    found = similarity.similar_pairs(one, two, ["block", "k"], "a", "b", least, contained).collect()
    expected = {(x, a, b): score(a, b, contained) for x, _, a in set(left) for y, _, b in set(right) if x and x == y and a and b and score(a, b, contained) >= least}
    assert len(found) == len(expected) and {(r.block, r.a, r.b): r.similarity for r in found} == expected and all(r.k == 1 for r in found)


def test_few_candidates_and_hot_elements(spark, monkeypatch):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(6, 40))) for _ in range(600)})
    texts += [t[:-1] + "#" for t in texts[:100]]
    df = spark.createDataFrame([("one", t) for t in texts], "block string, value string")
    met = similarity.candidates(df, df, 0.8)
    pairs = [tuple(r) for r in met.select("a", "b").collect()]
    assert len(pairs) == len(set(pairs)) < 0.05 * len(texts) ** 2
    assert {(a, b) for a in texts for b in texts if score(a, b, False) >= 0.8} <= set(pairs)
    monkeypatch.setattr(similarity, "ROWS", 20)
    assert sorted(tuple(r) for r in similarity.candidates(df, df, 0.8).select("a", "b").collect()) == sorted(pairs)


def test_best_and_empty(spark):
    pairs = spark.createDataFrame([("t", "a", "b", 0.8), ("t", "a", "c", 0.9), ("t", "a", "d", 0.9), ("u", "a", "e", 0.1)], "k string, a string, b string, similarity double")
    assert sorted(r.b for r in similarity.best_similar(pairs, ["k", "a"]).collect()) == ["c", "d", "e"]
    none = spark.createDataFrame([], "k string, a string")
    assert similarity.similar_pairs(none, none.withColumnRenamed("a", "b"), ["k"], "a", "b", 0.7).count() == 0
    with pytest.raises(ValueError):
        similarity.candidates(none, none, 0.0)


#: Pairs of texts and their scores by the definition (twice the matched characters over all, matches longest first).
SCORED = [
    ("visit date", "visit date", 1.0), ("visit", "visit date", 0.5), ("subject id", "subjid", 0.75), ("weight kg", "height cm", 0.666667), ("abcd", "dcba", 0.25), ("adverse event term", "adverse events", 0.8125),
    ("体重", "体重变化", 0.5), ("性别", "出生日期", 0.0), ("", "", 0.0), ("a", "", 0.0), ("aab", "aba", 0.666667), ("lab test name", "test lab name", 0.692308), ("systolic pressure", "diastolic pressure", 0.857143),
    ("x", "y", 0.0), ("medication", "mediation", 0.947368), ("start", "end", 0.0),
]


def test_scores_of_pairs(spark):
    pairs = spark.createDataFrame(SCORED, "a string, b string, score double")
    assert all(r.found == r.score for r in pairs.withColumn("found", F.round(text.fuzzy_score(F.col("a"), F.col("b")), 6)).collect())


FORMS = [("f1", "Visit", "Visit date"), ("f2", "visit (form)", "visit_date"), ("f3", "visits", "visit date"), ("f4", "Visit", "visit dates"), ("f5", "other", "none"), ("f6", None, "x"), ("f7", "", "")]
RECORDS = [("r1", "visit", "visit date"), ("r2", "visit", "visit date"), ("r3", "visitor", "visit date"), ("r4", "lab", "test"), ("r5", None, "x"), ("r6", "", "")]


def test_strategies_in_order(spark):
    """The first strategy with a match decides; all its ties stay; thresholds are asked afterwards."""
    ids = {k: n for n, (k, _, _) in enumerate(FORMS + RECORDS)}
    names = {n: k for k, n in ids.items()}
    vec = {"f5": [1.0, 0.0], "r4": [0.99, 0.1], "f1": [0.0, 1.0]}
    rows = lambda data: spark.createDataFrame([(ids[k], t, v, vec.get(k)) for k, t, v in data], "id bigint, t string, v string, vec array<double>")
    probe, records = (front.prepared(rows(d), "id", "t", "v", vec="vec") for d in (FORMS, RECORDS))
    found = front.strategy_matches(probe, records)
    got = sorted((names[r.key], names[r.record], r.strategy, r.confidence) for r in found.collect())
    assert got == [
        ("f1", "r1", "exact", 1.0), ("f1", "r2", "exact", 1.0), ("f2", "r1", "normalised", 0.95), ("f2", "r2", "normalised", 0.95), ("f3", "r1", "fuzzy_table", 0.9), ("f3", "r2", "fuzzy_table", 0.9),
        ("f4", "r1", "fuzzy_variable", 0.87), ("f4", "r2", "fuzzy_variable", 0.87), ("f5", "r4", "vector", 0.95),
    ]
    asked = front.query_front(probe, found, {"fuzzy_table": 0.91, "vector": 0.95}, 0.8)
    answers = {names[r.key]: (r.source, r.strategy, r.n) for r in asked.collect()}
    assert answers == {"f1": ("direct", "exact", 2), "f2": ("direct", "normalised", 2), "f3": ("reasoning", "fuzzy_table", 0), "f4": ("direct", "fuzzy_variable", 2), "f5": ("direct", "vector", 1), "f6": ("reasoning", None, 0), "f7": ("reasoning", None, 0)}
    assert front.suggestions(found, asked).count() == 7


def test_precomputed_keys_come_first(spark):
    df = spark.createDataFrame([(1, "a", "b", "C "), (2, "a", "b", "d")], "id bigint, t string, v string, w string")
    kb = spark.createDataFrame([(10, "A", "B", "c"), (11, "a", "b", "e")], "id bigint, t string, v string, w string")
    found = front.strategy_matches(*(front.prepared(x, "id", "t", "v", ("t", "v", "w")) for x in (df, kb)))
    assert sorted((r.key, r.record, r.strategy) for r in found.collect()) == [(1, 10, "precomputed"), (2, 10, "exact"), (2, 11, "exact")]


def test_copies_are_counted_and_dealt(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS", 50)
    left = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    right = spark.range(90).select(F.col("id").alias("r"), F.when(F.col("id") < 80, 0).otherwise(F.col("id")).cast("long").alias("g"))
    found = similarity.dealt_join(left, right, ["g"])
    assert sorted(map(tuple, found.select("k", "g", "r").collect())) == sorted((k, 0, r) for k in range(0, 100, 2) for r in range(80))
    assert found.where("g = 0").select(F.spark_partition_id()).distinct().count() > 1  # one key, several tasks
    probe, records = (df.select(F.col("id"), F.lit("Vitals").alias("t"), F.when(F.col("id") % 2 == 0, "pulse rate").otherwise("pulse rates").alias("v"), F.lit(None).cast("array<float>").alias("vec")) for df in (spark.range(10), spark.range(100, 160, 2)))
    probe, records = (front.prepared(df, "id", "t", "v", vec="vec") for df in (probe, records))
    counts = {r.key: (r.strategy, r.n) for r in front.strategy_counts(probe, records).collect()}
    assert counts == {k: ("exact" if k % 2 == 0 else "fuzzy_variable", 30) for k in range(10)}
    links = front.strategy_links(session.written(probe, "probe"), session.written(records, "records"))
    assert links.count() == 10 and front.strategy_matches(probe, records).count() == 300  # one link a row, however many copies
