"""Alignment against both libraries and plain loops over the ends of tokens."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weftline.llm import alignment
from weftline.llm.queries import op11_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    # The byte-level alphabet as its authors publish it: printable characters stand for themselves.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    vocabulary = {i: p for p, i in json.load(open(A))["model"]["vocab"].items()}
    a_bytes = lambda i: bytes(of[c] for c in vocabulary[i])

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    return a, b, a_bytes, b_bytes


def plain(rows, libraries):
    a, b, a_bytes, b_bytes = libraries
    docs, corpus = [], Counter()
    for key, text in rows:
        text = text or ""
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + text).encode()
        if b"".join(map(a_bytes, ia)) != whole or b"".join(map(b_bytes, ib)) != whole:
            docs.append((key, [], [], [], []))
            continue
        ends = []
        for ids, of in ((ia, a_bytes), (ib, b_bytes)):
            at, out = 0, {}
            for k, i in enumerate(ids):
                at += len(of(i))
                out[at] = k
            ends.append(out)
        both = sorted(ends[0].keys() & ends[1].keys())
        groups, links, x, y = [], [], 0, 0
        for end in both:
            p, q = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(map(str, ia[x:p])) + "|" + ",".join(map(str, ib[y:q])))
            links.append((ia[p - 1], ib[q - 1]))
            x, y = p, q
        corpus.update(links)
        docs.append((key, ia, ib, groups, links))
    best = {}
    for (_, y), n in corpus.items():
        best[y] = max(best.get(y, 0), n)
    return [(key, len(ia), len(ib), len(groups), len(links), sum(corpus[x] == best[x[1]] for x in links), sum(corpus[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else "") for key, ia, ib, groups, links in docs]


def rows_of(found):
    return sorted(map(str, (tuple(r) for r in found.collect())))


AWKWARD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces  "), (5, "a<|endoftext|>b <s> </s> <unk> <0x41>"), (6, "it's we'll DON'T 12 345 ½ x²"), (7, "▁marked"), (8, "日本語 テキスト ünïcödé naïve"),
    (9, "tabs\tand\r\n\nlines \x1c\x85\xa0end "), (None, "no id"), (None, "no id"), (10, "same row"), (10, "same row"), (10, "same id, other text"), (11, "word soup " * 30000), (12, "a" * 50000), (13, "🙂👩‍👩‍👧 \U0010ffff \x00 \x7f"),
]


def test_documents(spark, small, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = op11_alignment(spark, small)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(found) == sorted(map(str, plain(rows, libraries)))


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40])
def test_awkward_rows(spark, libraries, monkeypatch, frequent):
    """Also with few frequent pairs, so that most links find their counts by the join."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in AWKWARD], "doc_id bigint, text string, id int, groups string")
    assert rows_of(alignment.alignment(df, A, B)) == sorted(map(str, plain(AWKWARD, libraries)))
    assert alignment.alignment(df.limit(0), A, B).collect() == []


def test_parts_of_a_long_document(spark, libraries):
    """The machine hands on a long document in parts that make up the groups of the whole."""
    text = "The quick brown fox, it's a dog's life. " * 20000
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id bigint, text string")
    found = sorted(alignment.swept(df, open(A).read(), open(B, "rb").read()).collect(), key=lambda r: (r.id, r.part))
    long_ = [r for r in found if r.id == 1]
    expected = plain([(1, text)], libraries)[0]
    assert len(long_) > 1 and [r.part for r in long_] == list(range(len(long_)))
    assert tuple(sum(r[c] for r in long_) for c in ("n_a", "n_b", "n_groups", "n_links")) == expected[1:5]
    assert hashlib.sha256(";".join(r.groups for r in long_).encode()).hexdigest() == expected[7]
    assert [(r.n_a, r.groups) for r in found if r.id == 3] == [(0, "")]


def test_chunks_are_encoded_as_whole_texts(libraries):
    """The ids of the chunks are those of the libraries for the text."""
    pair = alignment.Pair(open(A).read(), open(B, "rb").read())
    extra = ["\n x", "a\n\n  b", "　 x　", "x \u2028 y", " \t \n z", "it 's  'll", "tail  ", "12 ,5 %  \r\n \r"]
    texts = [t for _, t in AWKWARD if t] + extra
    for text, both in zip(texts, pair.encode(texts)):
        if both is None:
            assert "▁" in text
            continue
        a, b = (alignment.np.frombuffer(x, pair.kind).tolist() for x in both)
        assert a == libraries[0].encode(" " + text, add_special_tokens=False).ids and b == libraries[1].encode(text)


def test_a_third_of_all_rows_is_one_row(spark, libraries):
    """Rows that agree are put together in each task, and each is a result."""
    rows = [(7, "one row, again and again")] * 400 + [(k, f"text {k} of many") for k in range(100, 900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    shared = spark.sparkContext.broadcast((open(A).read(), open(B, "rb").read()))
    assert alignment.events(df.where("doc_id = 7"), shared, "doc_id", "text").where("at < 0").count() <= 3
    assert rows_of(alignment.alignment(df, A, B)) == sorted(map(str, plain(rows, libraries)))
