"""Encoding and decoding against the library, spans against the text, and a compiled character map against the library's normaliser."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece as library

from weftline.llm import sentencepiece_codec as s
from weftline.llm.queries import op5_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
PROCESSOR = library.SentencePieceProcessor(model_file=PATH)
AWKWARD = ["", " ", "  a  b", "▁x▁ ", "日本語テスト 😀 \n\t\x00", "a" * 300, "ab " * 50 + "   end  ", "<s> </s><unk>", "é ﬁ", "a▁▁b", "x" * 5000 + " y" * 5000]


def test_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op5_sentencepiece(spark, small).collect():
        ids = PROCESSOR.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(PROCESSOR.decode(ids).encode()).hexdigest()


def test_awkward_rows_and_spans(spark):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, None), (1, " "), (99, None)]
    df = spark.createDataFrame([(k, t, [1], "x") for k, t in rows], "doc_id bigint, text string, ids array<int>, decoded string")
    found = s.sentencepiece(df, PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        text = AWKWARD[r.doc_id] if r.doc_id is not None and r.doc_id < 99 else ""
        assert r.ids == PROCESSOR.encode(text) and r.decoded == PROCESSOR.decode(r.ids)
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(r.piece_start, r.piece_end, strict=True)) == data
    assert s.sentencepiece(df.limit(0), PATH).count() == 0


def test_any_ids_decode_like_the_library():
    with open(PATH, "rb") as file:
        model = s.Model(file.read())
    rng = random.Random(5)
    for _ in range(2000):
        # The library joins broken bytes that lie side by side in its own way; whole pieces and single bytes are equal.
        ids = [rng.choice([rng.randrange(259, 32000), rng.randrange(3, 131)]) for _ in range(rng.randrange(8))]
        assert model.decode(ids) == PROCESSOR.decode(ids), ids


def test_character_map_of_nfkc():
    normaliser = library.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    spec = next(v for n, v in s._fields(normaliser.serialized_model_proto()) if n == 3)
    chars = s.CharacterMap(next(v for n, v in s._fields(spec) if n == 2))
    for text in ["ﬁne ＡＢＣ １２", "été ½ ㌔", "plain", "한글 ﷺ x y", ""]:
        out, starts = chars.apply(text)
        assert out == normaliser.normalize(text)
        assert len(starts) == len(out) + 1 and starts == sorted(starts) and starts[-1] == len(text.encode())


def slow_spans(model, text):
    """Spans piece by piece, as a walk over characters."""
    normal, starts = model.normalise(text)
    ids = model.encode_normalised(normal).tolist()
    if starts is None:
        starts, at = [0] * bool(model.prefix and normal), 0
        for c in text:
            starts.append(at)
            at += len(c.encode())
        starts.append(at)
    out, at, inside = [], 0, 0
    for i in ids:
        if i in model.byte_ids:
            width = len(normal[at].encode())
            whole = starts[at + 1] - starts[at] == width
            inside += 1
            out.append((starts[at] + inside - 1, starts[at] + inside) if whole else (starts[at], starts[at + 1]))
            if inside == width:
                at, inside = at + 1, 0
        else:
            size = len(model.bytes_of[i].decode())
            out.append((starts[at], starts[at + size]))
            at += size
    return ids, out


def test_spans_through_a_character_map_lead_back_to_the_text():
    """The given model has an empty map, so a model with the map of nmt_nfkc is put together here."""
    with open(PATH, "rb") as file:
        model = s.Model(file.read())
    normaliser = library.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    spec = next(v for n, v in s._fields(normaliser.serialized_model_proto()) if n == 3)
    plain = model.map
    mapped = s.CharacterMap(next(v for n, v in s._fields(spec) if n == 2))
    rng = random.Random(8)
    texts = [*AWKWARD, "ﬁne ＡＢＣ １２", "été ½ ㌔", "한글 ﷺ x y", "e\u0301 \u3000 z"]
    texts += ["".join(rng.choice("abc ﬁ㌔é😀½日 \t") for _ in range(rng.randrange(60))) for _ in range(300)]
    for model.map in (plain, mapped):
        for model.squeeze in (False, True):
            for text in texts:
                ids, begin, end = model.encode_spans(text)
                data = text.encode()
                assert (ids.tolist(), list(zip(begin.tolist(), end.tolist(), strict=True))) == slow_spans(model, text), text
                # Each span's source, normalised by itself, has the piece; spans go on through the text.
                assert all(0 <= a <= b <= len(data) for a, b in zip(begin, end, strict=True)) and (np.diff(begin) >= 0).all()
                if model.map is mapped and not model.squeeze and ids.size and not set(ids.tolist()) & model.byte_ids:
                    assert begin[0] == 0 and end[-1] == len(data)


def test_query_returns_a_digest_of_the_spans(spark, small):
    found = {r.doc_id: r.spans_xxh64 for r in op5_sentencepiece(spark, small).collect()}
    rows = s.sentencepiece(spark.read.parquet(f"{small}/documents.parquet"), PATH).selectExpr("doc_id", "xxhash64(piece_start, piece_end) as h", "ids", "piece_end", "piece_start").collect()
    assert {r.doc_id: r.h for r in rows} == found and len(set(found.values())) > 1
    assert all(len(r.ids) == len(r.piece_start) == len(r.piece_end) for r in rows)
