"""BM25 matches by block-max WAND against scores of all items, and leaks of benchmark passages."""

import math
import random

import pytest

from weftline.llm import decontamination as d
from weftline.llm.queries import op2_decontamination


def test_wand_returns_all_above_the_threshold():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, rng.choices(vocabulary, k=rng.randint(3, 12)), rng.choices(vocabulary, k=2)) for i in range(150)]
    frequency = {w: sum(w in q + a for _, q, a in items) for w in vocabulary}
    terms_of = {w: k for k, w in enumerate(vocabulary)}
    index = d.Index(items, terms_of, 32, frequency, len(items), 9.0)
    for threshold in (0.2, 0.4, 0.7):
        for _ in range(150):
            terms = sorted({terms_of[w] for w in rng.choices(vocabulary, k=14) if index.docs[terms_of[w]]})
            scores = {}
            for t in terms:
                for doc, w in zip(index.docs[t], index.weights[t], strict=True):
                    scores[doc] = scores.get(doc, 0) + w
            expected = {k: v for k, v in scores.items() if v >= threshold - 1e-9}
            found = dict(index.above(terms, threshold))
            assert found == pytest.approx(expected)


def test_documents_with_whole_passages_are_found(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaks = {(r.doc_id, i) for r in spark.read.parquet(f"{small}/documents.parquet").collect() for i, t in items if t in r.text}
    found = op2_decontamination(spark, small).collect()
    pairs = {(r.doc_id, i) for r in found for i in r.items}
    assert leaks and leaks <= pairs
    # What is found beside whole passages holds most of an item's trigrams.
    texts = {r.doc_id: d.ngrams(d.words_of(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    grams = {i: d.ngrams(d.words_of(t)) for i, t in items}
    assert all(len(grams[i] & texts[k]) >= 0.5 * len(grams[i]) for k, i in pairs)


def test_awkward_rows_and_blocks(spark, monkeypatch):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    items = spark.createDataFrame([(1, text, 1), (2, None, 1), (3, "", 1), (4, "one two three four five six seven eight", 1)], "item_id bigint, text string, doc_id int")
    rows = [(1, "before " + text.upper() + " after"), (None, text), (3, None), (4, ""), (5, "x " * 9000 + text), (1, "nothing"), (6, "one two three four. Five six seven, eight")]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id bigint, text string, item_id int")
    once = sorted(map(str, d.decontaminate(docs, items).select("doc_id", "item_id").collect()))
    assert once == sorted(["Row(doc_id=1, item_id=1)", "Row(doc_id=None, item_id=1)", "Row(doc_id=5, item_id=1)", "Row(doc_id=6, item_id=4)"])
    monkeypatch.setattr(d, "INDEX_WORDS", 20)
    assert sorted(map(str, d.decontaminate(docs, items).select("doc_id", "item_id").collect())) == once
    assert d.decontaminate(docs, items.limit(0)).count() == 0 and d.decontaminate(docs.limit(0), items).count() == 0


def test_answer_must_be_there(spark):
    items = spark.createDataFrame([(1, "what is the name of the tall mountain in the far north land", "mount zebulon the great")], "item_id bigint, question string, answer string")
    docs = spark.createDataFrame([(1, "what is the name of the tall mountain in the far north land"), (2, "what is the name of the tall mountain in the far north land? mount zebulon the great")], "doc_id bigint, text string")
    found = d.decontaminate(docs, items, question_column="question", answer_column="answer", threshold=0.4)
    assert [r.doc_id for r in found.collect()] == [2]


def plain(rows, items, threshold=d.THRESHOLD, question=d.QUESTION, answer=d.ANSWER):
    """Every passage against every item by the definition: BM25 shares summed term by term, then trigrams of the passage."""
    items = {(i, q, a) for i, q, a in items}
    parts = [(i, *d.split_item(d.words_of(q), d.words_of(a))) for i, q, a in sorted(items, key=str)]
    parts = [p for p in parts if p[1] or p[2]]
    mean = sum(len(q) + len(a) for _, q, a in parts) / max(1, len(parts))
    df = {}
    for _, q, a in parts:
        for w in set(q + a):
            df[w] = df.get(w, 0) + 1
    out = []
    for key, text in rows:
        words = d.words_of(text)
        for item, q, a in parts:
            both = q + a
            step = next(s for s in (32 << k for k in range(30)) if s >= len(both))
            weight = {w: math.log(1 + (len(parts) - df[w] + 0.5) / (df[w] + 0.5)) * both.count(w) * 2.2 / (both.count(w) + 1.2 * (0.25 + 0.75 * len(both) / mean)) for w in both}
            for at in range(0, max(1, len(words) - step), step):
                passage = words[at : at + 2 * step]
                score = sum(v for w, v in weight.items() if w in passage) / sum(weight.values())
                if score < threshold - 1e-9:
                    continue
                runs = {tuple(passage[i : i + 3]) for i in range(len(passage) - 2)}
                share = []
                for part in (q, a) if len(both) > 2 else (both, both):
                    grams = {tuple(part[i : i + 3]) for i in range(len(part) - 2)}
                    share.append(len(grams & runs) / len(grams) if grams else float(any(passage[i : i + len(part)] == part for i in range(len(passage) + 1 - len(part)))))
                if share[0] >= question and share[1] >= answer:
                    out.append((key, item))
                    break
    return sorted(out, key=str)


def test_query_is_that_of_all_passages_and_items(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text, None) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    found = sorted(((r.doc_id, i) for r in op2_decontamination(spark, small).collect() for i in r.items), key=str)
    assert found == plain(rows, items) and found


def test_edited_passages_against_the_plain_search(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30))), rng.choice([None, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6)))])) for i in range(60)]
    items += items[:3]
    rows = []
    for k in range(200):
        words = rng.choices(vocabulary, k=rng.randint(0, 200))
        _, q, a = rng.choice(items)
        copy = [w if rng.random() > 0.08 * (k % 5) else "x" for w in (q + " " + (a or "")).split()]
        at = rng.randint(0, len(words))
        rows.append((k, " ".join(words[:at] + copy + words[at:])))
    frame = spark.createDataFrame(items, "item_id bigint, text string, reply string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = d.decontaminate(docs, frame, answer_column="reply").select("doc_id", "item_id").collect()
    expected = plain(rows, items)
    assert sorted(map(tuple, found), key=str) == expected and len(expected) > 50


def test_rows_of_one_id_and_null_ids_have_their_own_verdict(spark):
    text = "where the old river bends there stands a mill that turns no more since the great flood"
    items = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    rows = [(None, text), (None, "clean one"), (7, "clean two"), (7, f"so {text} ok"), (None, None), (7, "clean two")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, text_hash int")
    found = d.verdicts(docs, d.decontaminate(docs, items)).collect()
    assert sorted(str((r.doc_id, r.contaminated)) for r in found) == sorted(str((k, text in (t or ""))) for k, t in rows)


def test_short_items_and_scattered_words(spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "a b"), (3, "red fox jumps high over old stone wall")], "item_id bigint, text string")
    scattered = "red fox jumps " + "x " * 90 + "fox jumps high " + "y " * 90 + "jumps high over old stone wall"
    docs = spark.createDataFrame([(1, "Paris in spring a b"), (4, "a word, then b, parisian"), (2, scattered), (3, "the red fox jumps high over old stone wall")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.decontaminate(docs, items).collect()) == [(1, 1), (1, 2), (3, 3)]


def test_a_verdict_does_not_hang_on_the_length_of_other_items(spark):
    """Trigrams of a short item 200 words apart are no passage, however long another item is."""
    rng = random.Random(9)
    item = [f"t{i}" for i in range(15)]
    scattered = " ".join(" ".join(item[i : i + 3]) + " " + " ".join(f"f{rng.randrange(10**6)}" for _ in range(200)) for i in range(13))
    long_ = " ".join(f"z{rng.randrange(10**6)}" for _ in range(3000))
    docs = spark.createDataFrame([(1, scattered), (2, f"x {' '.join(item)} y"), (3, f"a b {long_} c")], "doc_id bigint, text string")
    for texts in ([" ".join(item)], [" ".join(item), long_]):
        items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
        found = sorted((r.doc_id, r.item_id) for r in d.decontaminate(docs, items).collect())
        assert found == [(2, 0), (3, 1)][: len(texts)]
