"""Token files against the library's own encoding, and the index against a dictionary."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weftline.llm import token_files as tf
from weftline.llm.common import written
from weftline.llm.queries import op8_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert sorted(map(tuple, op8_token_files(spark, small).collect())) == expected(rows)


def test_awkward_rows(spark):
    rows = [(3, "It's Á Test x  "), (1, None), (2, ""), (9, "<|endoftext|> ab<|endoftext|>cd"), (7, "\x1c\x85   1234 'll"), (8, "word " * 20000), (5, "İstanbul ΣΑΣ ﬁ \r\nx")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, shard int, key int")
    path = tf.new_folder(spark)
    manifest = written(tf.write_token_files(df, path, PATH, 2, shards=3), "manifest")
    found = sorted(tuple(r) for r in tf.read_token_files(manifest, path).select("id", "start", "n_tokens", "ids_crc32").collect())
    assert found == expected(sorted(rows, key=lambda r: r[0]))
    shard = tf.Shard(path, 0)
    assert len(shard.get(1)) == 1 and shard.get(123456) is None
    assert tf.read_token_files(written(tf.write_token_files(df.limit(0), tf.new_folder(spark), PATH, 2), "manifest"), path).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "c"), (4, "c"), (4, "d d")], "doc_id bigint, text string")
    path = tf.new_folder(spark)
    found = tf.read_token_files(written(tf.write_token_files(df, path, PATH, 2, shards=1), "manifest"), path).collect()
    assert [(r.id, r.nth) for r in found] == [(None, 0), (4, 0), (4, 1), (4, 2)]
    assert [r.start for r in found] == list(np.cumsum([0, *[r.n_tokens for r in found]])[:-1])


def test_perfect_hash_is_minimal_and_turns_foreign_keys_away():
    ids, nth = np.arange(0, 70000, 7), np.zeros(10000, np.int64)
    hash_ = tf.PerfectHash.build(ids, nth)
    assert sorted(hash_.slots(ids, nth).tolist()) == list(range(10000))
    again, _ = tf.PerfectHash.load(hash_.dump(), 0, len(hash_.bits), len(hash_.rest))
    assert (again.slots(ids, nth) == hash_.slots(ids, nth)).all()


def test_keyed_access_by_seeks(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    extra = [(None, "no id"), (rows[5][0], "same id"), (10**9, "many"), *[(10**9 + 1, f"copy {i}") for i in range(40)], (10**9 + 2, None)]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string")
    path = tf.new_folder(spark)
    manifest = written(tf.write_token_files(df, path, PATH, 2, shards=30), "manifest")
    files = tf.TokenFiles(manifest, path)
    tokenizer, found = Tokenizer.from_file(PATH), {}
    ids = lambda t: (*tokenizer.encode(t or "", add_special_tokens=False).ids, 2)
    expected = {}
    for key, text in rows + extra:
        expected.setdefault(key, []).append(ids(text))
    for key, texts in expected.items():
        got = [tuple(files.get(key, i)) for i in range(len(texts))]
        assert sorted(got) == sorted(texts), key
        assert files.bytes_read < 4 * len(got[-1]) + 60 * 72 + 1000
        assert files.get(key, len(texts)) is None
        found[key] = got
    assert [tf.lookup(manifest, path, k) for k in (-5, 10**10)] == [None, None]
    # Order over shards is that of the files.
    back = tf.read_token_files(manifest, path).orderBy("start").collect()
    assert [tuple(r.ids) for r in back if r.id == 10**9 + 1] == found[10**9 + 1]


def test_a_repeated_try_leaves_a_whole_shard(spark):
    path = tf.new_folder(spark)
    for _ in range(2):
        writer = tf.ShardWriter(path, 0, 2)
        for k in range(1000):
            writer.add(k, np.array([k, 2], np.uint32))
        writer.close()
    unfinished = tf.ShardWriter(path, 0, 2)
    unfinished.add(7, np.array([1], np.uint32))
    shard = tf.Shard(path, 0)
    assert all(shard.get(k).tolist() == [k, 2] for k in range(0, 1000, 37))
    names = [i.base_name for i in shard.files.get_file_info(tf.fs.FileSelector(path.removeprefix("file://")))]
    assert sorted(n for n in names if n.count(".") == 1) == ["shard-000000.ids", "shard-000000.mph"] and len(names) == 3
