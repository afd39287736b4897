"""Answers of models, stores, keyword automata and sequential context, by hand and against plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import mapping, text
from weftline.operators import keywords, match, ranking, recommend
from weftline.sources import readers


def test_store_embeds_only_new_texts_and_skips_failed_batches(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(texts):
        for t in texts:
            (calls / f"{t}.{len(list(calls.iterdir()))}").touch()
        if "bad" in texts:
            raise TimeoutError
        return [[float(len(t))] for t in texts]

    store = str(tmp_path / "store")
    rows = lambda *texts: spark.createDataFrame([(t, 1) for t in texts], "t string, embedding int").repartition(1)
    seen = lambda: sorted(p.name.rpartition(".")[0] for p in calls.iterdir())
    first = recommend.embedded(rows("a", "a", " ", None, "bb"), "t", store, model, 1)
    assert sorted((r.text, r.embedding) for r in first.collect()) == [("a", [1.0]), ("bb", [2.0])] and seen() == ["a", "bb"]
    second = recommend.embedded(rows("a", "bad", "ccc"), "t", store, model, 1)
    assert sorted(r.text for r in second.collect()) == ["a", "ccc"] and seen() == ["a", "bad", "bb", "ccc"]
    assert recommend.embedded(rows("bb", "a"), "t", store, model, 1).count() == 2 and seen() == ["a", "bad", "bb", "ccc"]
    recommend.embedded(rows("bad"), "t", store, model, 1)
    assert seen().count("bad") == 2  # tried again


@pytest.mark.parametrize(("said", "found"), [('{"a": 1}', {"a": 1}), ('x {y} ```json\n{"a": {"b": 2}}\n``` {"c": 3}', {"a": {"b": 2}}), ("[1, 2]", None), ('{"a": ', None), (None, None), ("{}", None)])
def test_first_object(said, found):
    assert recommend.first_object(said) == found


def test_targets_retry_and_fall_back(spark):
    def model(prompt, n):
        if prompt == "twice" and n == 0:
            return "no json"
        if prompt == "fails":
            raise OSError
        return json.dumps({"domain": "ae ", "sdtm_variable": "AETERM", "score": "high" if prompt == "odd" else 0.8}) if prompt != "none" else '{"domain": 3, "sdtm_variable": "X"}'

    rows = spark.createDataFrame([(1, "ok", "v", "dm"), (2, "twice", "v", "dm"), (3, "fails", "v1", " dm "), (4, "none", "v1", None), (5, "odd", "v", "")], "k int, p string, n string, d string")
    found = {r.k: (r.domain, r.variable, r.score, r.source, r.tries, r.reason) for r in recommend.infer_targets(rows, "k", "p", "n", "d", model).collect()}
    assert found == {1: ("AE", "AETERM", 0.8, "LLM", 1, None), 2: ("AE", "AETERM", 0.8, "LLM", 2, None), 3: ("DM", "DM_V1_PENDING", 0.0, "FALLBACK", 2, "OSError"), 4: ("UNMAPPED", "UNMAPPED_V1_PENDING", 0.0, "FALLBACK", 2, "no target"), 5: ("AE", "AETERM", 0.0, "LLM", 1, None)}


def test_only_the_top_answer_is_checked(spark):
    catalogue = spark.createDataFrame([("AE", "AETERM"), ("AE", "AESTDTC"), ("AE", "AETERMX"), ("DM", "AGE")], "domain string, variable string")
    rows = spark.createDataFrame([(1, "ae", "AETERM", 0.9, 1), (1, "DM", "AGE", 0.8, 2), (2, "AE", "TERM", 0.5, 1), (3, "ZZ", "ZZX", None, 1), (4, None, None, 0.1, 1)], "k int, domain string, variable string, score double, seq int")
    found = {(r.k, r.seq): (r.validated, r.validity, r.issues, r.suggestions) for r in recommend.checked_top(rows, catalogue, "k", "score", "seq").collect()}
    assert found[1, 1] == (True, 1.0, [], []) and found[1, 2] == (None, None, None, None)
    assert found[2, 1] == (False, 0.42, ["variable TERM not found in AE"], ["AETERM", "AETERMX"])
    assert found[3, 1][0] is False and found[3, 1][2:] == (["domain ZZ not found"], []) and found[4, 1] == (False, 0.0, [], [])


def test_automaton_is_the_nested_loop(spark, monkeypatch):
    rng = random.Random(4)
    letters = "abé-1 "
    listed = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"AB", "体重", "é"})
    words = [(w, f"l{k % 7}", k) for k, w in enumerate(listed)]
    texts = [(k, "".join(rng.choice(letters + "AB") for _ in range(rng.randint(0, 30)))) for k in range(200)] + [(900, None), (901, "x体重x"), (902, "体重")]
    df, table = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(words, "word string, label string, seq int")
    for size in (200_000, 40):
        monkeypatch.setattr(keywords, "WORDS", size)
        longest, tokens, labels = set(), set(), {}
        for k, t in texts:
            low = (t or "").lower()
            held = [(w, label, n) for w, label, n in words if w.lower() in low]
            if held:
                longest.add((k, *min(held, key=lambda h: (-len(h[0]), h[2]))[:2]))
            tokens |= {(k, w) for w, _, _ in held if len(w) > 3 or low == w.lower() or w.lower() in re.split("[^a-z0-9]+", low)}
            labels[k] = list(dict.fromkeys(label for _, label, _ in held))
        assert {(r.id, r.word, r.label) for r in match.longest_keyword(df, "id", "t", table).collect()} == longest
        assert {(r.id, r.word) for r in match.keyword_hits(df, "t", table).collect()} == {(k, w) for k, w in tokens if w}
        assert {r.id: r.labels for r in match.keyword_outcomes(df, "id", "t", table).collect()} == labels
    assert match.keyword_hits(df, "t", table.limit(0)).count() == 0


def test_a_list_counts_its_words_once(spark, monkeypatch):
    words = [(w, label, k) for k, (w, label) in enumerate([("bolt", "b"), ("Bolt", "c"), ("hot", "a"), ("hot", None), ("bolt", "b")] * 40)]
    df, table = spark.createDataFrame([(1, "HOT bolt"), (2, "bolt"), (3, None)], "id int, t string"), spark.createDataFrame(words, "word string, label string, seq int")
    made, held = [], keywords._held
    monkeypatch.setattr(keywords, "WORDS", 2)
    monkeypatch.setattr(keywords, "_held", lambda *given: made.append(1) or held(*given))
    assert {r.id: (r.word, r.label, r.seq) for r in match.longest_keyword(df, "id", "t", table).collect()} == {1: ("bolt", "b", 0), 2: ("bolt", "b", 0)}
    assert len(made) == 1  # two words, not two hundred
    assert {r.id: r.labels for r in match.keyword_outcomes(df, "id", "t", table).collect()} == {1: ["b", "c", "a", None], 2: ["b", "c"], 3: []}
    assert len(made) == 3


def test_a_fold_sees_the_answers_before(spark):
    rows = [(k, n, "x" * n, "given" if n == 3 else None) for k in ("a", "b", None) for n in range(1, 25)]
    df = spark.createDataFrame(rows, "k string, n int, t string, done string").repartition(5)
    found = ranking.folded(df, ["k"], ["n"], ["t"], lambda row, earlier: None if row["n"] == 5 else f"{row['n']}:{len(earlier)}:{earlier[0] if earlier else ''}", 4, "done")
    by = {(r.k, r.n): r.answer for r in found.collect()}
    for k in ("a", "b", None):
        assert [by[k, n] for n in range(1, 9)] == ["1:0:", "2:1:1:0:", "given", "4:3:1:0:", None, "6:4:1:0:", "7:4:2:1:1:0:", "8:4:given"]
    assert len(by) == 72


def test_domain_of_a_table(spark):
    said = mapping.table_domain(F.col("t"), {"adverse events": "AE", "labresults": "LB", "dm": "DM"}, [("conc", "CM")], [("vital", "VS"), ("vital signs x", "VX")], ["EX"])
    cases = {"Adverse Events": "AE", "lab results": "LB", "Prior conc meds": "CM", "Form（dm）": "DM", "x/dm": "DM", "vital signs x 2": "VX", "vital": "VS", "next": "EX", "old dm form": "DM", "": None, "zz": None}
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    assert {r.t: r.d for r in df.select("t", said.alias("d")).collect()} == cases | {None: None}


def test_originals_are_joined_once(spark):
    data = [("t1", [("a", 1.0), ("b", 2.0), (None, 3.0)], [("b", "x1"), ("b", "x2"), ("", "x3")])]
    df = spark.createDataFrame(data, "table_name string, recommendations array<struct<variable_name:string,score:double>>, originals array<struct<metadata_variable:string,annotation_variable:string>>")
    found = readers.nested_outputs(df, originals="originals").collect()
    assert [(r.variable_name, r.original_annotation_variable, r.matched) for r in found] == [("a", None, False), ("b", "x1", True), (None, "x3", True)]


def test_cases_of_a_catalogue(spark):
    df = spark.createDataFrame([("AE", k, f"V{k}", f"Label {k}", "Topic" if k == 0 else None, "Char") for k in range(5)], "d string, k int, n string, l string, r string, t string")
    found = text.evaluation_cases(df, "d", "k", "n", "l", "r", "t", 3).orderBy("number").collect()
    assert [(r.id, r.query, r.context) for r in found] == [("AE_0_direct", "Map 'Label 0' to SDTM variable", "Domain: AE, Role: Topic"), ("AE_0_functional", "Map the main topic field for label 0", "Domain: AE, Type: Char"), ("AE_1_direct", "Map 'Label 1' to SDTM variable", "Domain: AE, Role: Unknown")]


def test_listing_of_variables(spark):
    catalogue = spark.createDataFrame([(d, d.lower(), c, f"{d}{k}", k) for d, c in (("AE", "safety"), ("CM", "safety"), ("TU", "onco"), ("XX", "odd")) for k in range(10)], "domain string, name string, category string, variable string, place int")
    hints = spark.createDataFrame([(1, "AE", 1), (2, "XX", 1), (2, "CM", 2), (2, "TU", 3), (2, "ZZ", 4), (3, None, None)], "key int, domain string, place int")
    found = {(r.key, r.place): r.line for r in recommend.variable_listing(hints, catalogue, ["onco", "safety"], ["TU"]).collect()}
    assert [k for k in sorted(found)] == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 1)]
    assert found[1, 1] == "- AE (ae): " + ", ".join(f"AE{k}" for k in range(10))
    assert found[2, 1].startswith("- TU (tu): TU0, ") and found[2, 1].endswith("TU7, ... (+2 more)") and found[2, 3].startswith("- XX")
    assert found[3, 1].endswith("(+2 more)")


def test_a_line_is_made_once_for_its_domain(spark):
    catalogue = spark.createDataFrame([("AE", "ae", "safety", f"AE{k}", k) for k in range(10)], "domain string, name string, category string, variable string, place int")
    hints = spark.range(1, 400).select(F.col("id").alias("key"), F.lit("AE").alias("domain"), F.lit(1).alias("place"))
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda line: made.add(1) or f"{len(line)}", "string").asNondeterministic()
    found = recommend.variable_listing(hints, catalogue, ["safety"], [], count)
    assert {r.line for r in found.collect()} == {str(len("- AE (ae): " + ", ".join(f"AE{k}" for k in range(10))))} and found.count() == 399
    assert made.value == 2
