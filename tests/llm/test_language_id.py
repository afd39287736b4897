"""Language identification: accuracy on held-out documents, the distance by hand, rows of all kinds."""

import unicodedata
import zlib
from collections import Counter

from weftline.llm import language_id as l
from weftline.llm.queries import op9_language_id

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = op9_language_id(spark, DATA).collect()
    assert len(found) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id][0] for r in held) >= 0.99 * len(held) > 100


def brute(text, profiles, grams):
    counts = {}
    for word in l.WORDS.findall((text or "").lower()):
        for g in l.grams_of(word):
            counts[g] = counts.get(g, 0) + 1
    if not counts:
        return "und", 0.0
    own = sorted(counts, key=lambda g: (-counts[g], g))[:grams]
    apart = {lang: sum(abs(p[g] - i) if g in p else grams for i, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (grams * len(own))


def test_distance(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "die katze und der hund", "de"), (3, None, "en"), (4, "le chat et le chien", None), (5, "the the", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = l.learn_profiles(df, grams=30).collect()
    profiles = {}
    for r in learned:
        profiles.setdefault(r.lang, {})[r.gram] = r.rank
    assert set(profiles) == {"en", "de"} and all(len(p) == 30 for p in profiles.values())
    texts = [(1, "the hund"), (2, None), (3, ""), (None, "12 34 !?"), (5, "x " * 20000), (1, "the hund"), (7, "ÀÉ 日本語 die")]
    asked = spark.createDataFrame([(k, t, "q", 1.0) for k, t in texts], "doc_id bigint, text string, lang_pred string, score double")
    found = l.predict_languages(asked, l.learn_profiles(df, grams=30), grams=30).collect()
    assert sorted(str((r.doc_id, r.lang_pred, round(r.score, 9))) for r in found) == sorted(str((k, *(round(x, 9) if isinstance(x, float) else x for x in brute(t, profiles, 30)))) for k, t in texts)
    assert l.predict_languages(asked.limit(0), l.learn_profiles(df)).count() == 0
    assert {r.lang_pred for r in l.predict_languages(asked, l.learn_profiles(df.limit(0))).collect()} == {"und"}


def test_numbers_are_no_letters(spark):
    profiles = spark.createDataFrame([("en", "a", 0)], "lang string, gram string, rank int")
    asked = spark.createDataFrame([(1, "½ ² 3"), (2, "Ⅳ ① ٣"), (3, "ª"), (4, "½a")], "doc_id bigint, text string")
    found = {r.doc_id: r.lang_pred for r in l.predict_languages(asked, profiles).collect()}
    assert found == {1: "und", 2: "und", 3: "en", 4: "en"}


def test_profiles_are_those_of_a_recount(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(None, "en"), ("½ only", "xx"), ("a b", None)]
    counts = {}
    for text, lang in rows:
        if text is None or lang is None:
            continue
        word = ""
        for c in text.lower() + " ":
            if unicodedata.category(c).startswith("L"):
                word += c
                continue
            marked = f"_{word}_" if word else ""
            for n in (1, 2, 3):
                for i in range(len(marked) - n + 1):
                    if marked[i : i + n] != "_":
                        counts.setdefault(lang, Counter())[marked[i : i + n]] += 1
            word = ""
    expected = {(lang, g, k) for lang, c in counts.items() for k, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[:200])}
    df = spark.createDataFrame([(t, k, 1) for t, k in rows], "text string, lang string, rank int")
    learned = l.learn_profiles(df, grams=200)
    assert {tuple(r) for r in learned.collect()} == expected
    assert "WindowGroupLimit" in learned._jdf.queryExecution().executedPlan().toString()
