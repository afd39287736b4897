"""The stages of the pipeline, each on its own input."""

import random

import pyarrow as pa
import sentencepiece as library
import public_tokenizers

import corpus_pipeline as c
from weftline.llm import common, decontamination, simhash

DATA = "/root/testdata/sf0.001"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}

    kept = c.language_stage(spark, docs, DATA)
    assert sorted(kept.columns) == sorted(c.COLUMNS)
    assert {r.doc_id for r in kept.collect()} == set(before)  # all of them are prose in a known language

    lines = c.line_stage(spark, docs, DATA).collect()
    assert {r.doc_id for r in lines} == set(before)
    assert all(set(r.text.split("\n")) <= set(before[r.doc_id].text.split("\n")) | {""} and r.n_chars == len(r.text) for r in lines)

    near = {r.doc_id for r in c.near_duplicate_stage(spark, docs, DATA).collect()}
    sets = {k: shingles(r.text) for k, r in before.items()}
    gone = set(before) - near
    assert gone
    for a in before:
        for b in before:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                assert not {a, b} <= near
    for a in gone:  # each had something as much like it as the stage asks for
        assert max(jaccard(sets[a], sets[b]) for b in before if b != a) >= 0.8

    clean = {r.doc_id for r in c.decontamination_stage(spark, docs, DATA).collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = [decontamination.ngrams(decontamination.words_of(t)) for t in items]
    for k, r in before.items():
        leak = any(t in r.text for t in items)
        assert not (leak and k in clean)
        if k not in clean:
            own = decontamination.ngrams(decontamination.words_of(r.text))
            assert max(len(g & own) / len(g) for g in grams) >= 0.5

    processor = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in c.encoding_stage(spark, docs, DATA).limit(50).collect():
        assert r.ids == processor.encode(before[r.doc_id].text)


def test_run_and_awkward_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34 !?", "en", "s", 8), (None, "the of and that is with the was", None, "s", 31), (5, "the of and that is with the was", "en", "s", 31), (5, "the of and that is with the was", "en", "s", 31), (7, "word " * 9000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "none of this is in there at all")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = c.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in found) == ["5", "7", "None"]
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    spark.catalog.clearCache()
    assert c.run(spark, str(tmp_path)).count() == 0


def test_similarity_and_words_are_those_asked_for():
    import inspect

    defaults = inspect.signature(simhash.near_duplicates).parameters
    assert defaults["words"].default == 5 and defaults["similarity"].default == 0.8


def test_rows_of_one_id_with_different_texts_stay(spark):
    rows = [(5, "some words of one kind are here now", "en", "s", 1), (5, "and quite different things are said in this", "en", "s", 1), (5, "and quite different things are said in this", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert c.near_duplicate_stage(spark, docs, DATA).count() == 2


def test_gibberish_and_unlisted_languages_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    bad = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (8, 30, 200, 1000)]
    bad += [" ".join(f"{rng.getrandbits(32):x}" for _ in range(n)) for n in (10, 100, 600)]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    turkish = "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."
    bad += [polish, finnish, turkish]
    extra = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(bad)], docs.schema)
    kept = {r.doc_id for r in c.language_stage(spark, docs.unionByName(extra), "").collect()}
    clean = {r.doc_id for r in docs.collect()}
    assert clean - kept == set()
    assert {k for k in kept if k >= 10**6} == set()


def test_only_the_row_with_the_leak_goes(spark, tmp_path):
    leak = "where the old river bends there stands a mill that turns no more since the great flood"
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, leak), (None, "clean text of no id"), (7, "clean text of seven"), (7, f"and {leak} too"), (8, None), (7, "clean text of seven")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = c.decontamination_stage(spark, docs, str(tmp_path))
    assert found.columns == c.COLUMNS
    assert sorted(str(r.text) for r in found.collect()) == sorted(str(t) for _, t in rows if leak not in (t or ""))


def test_workers_hold_one_step_and_batches_are_small(spark):
    """What filled an executor: batches of 10,000 whole texts on both sides of its workers, as Python values at once, and the tables of stages that were over."""
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 100), pa.array(range(100))], names=["text", "id"])
    parts = list(common.slices(batch, 10_000))
    assert max(p.nbytes for p in parts) < 12_000 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in common.slices(batch.slice(0, 0))] == [0] and [p.num_rows for p in common.slices(batch)] == [100]

    class Shared:
        def __init__(self, value):
            self.value = value

    one, two, made = Shared(["one"]), Shared(["two"]), []
    for shared in (one, one, two, two):
        assert common.held(shared, lambda v: made.append(v) or v[0]) == shared.value[0]
        assert len(common._HELD) == 2
    assert made == [["one"], ["two"]]

    texts = spark.createDataFrame([(k, "word " * 20_000) for k in range(300)], "doc_id bigint, text string").repartition(1)
    seen = []
    stage = c.in_small_batches(lambda s, docs, _: docs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n bigint"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        seen = [r.n for r in stage(spark, texts, "").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    assert sum(seen) == 300 and max(seen) * 100_000 < 9 << 20
