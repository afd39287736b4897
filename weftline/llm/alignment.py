"""Alignment of two tokenizers over the same text by a sweep over the ends of their tokens.

Both encodings of a document become events: the byte offset where a token ends, the side, the id. A row carries a block of
events that follow each other on one side (its first offset and the ids; the offsets in it follow from the vocabulary's byte
lengths). The events of both sides are dealt by document and sorted by offset within the partitions, and a machine
streams through them that holds the tokens since the last byte where both sides ended, and running sums: as much for a
document of any length. Where both sides end it closes a group and links the two tokens that end there.

How often a pair of ids is linked in the corpus is counted over the machine's links. Pairs with more than a
``1 / FREQUENT`` of all links are fewer than ``FREQUENT``, whatever the corpus, and travel to all tasks; the links of all other pairs are joined
with their counts, and none of them has enough rows to be a hot key.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches, partitions, text_or_empty, written
from weftline.llm.sentencepiece_codec import MARK, Model

#: Events of a row, and links of a document after which the machine hands on a part of it.
BLOCK, PART = 8192, 1 << 16
#: Bound on the number of pairs whose counts travel to all tasks.
FREQUENT = 1 << 17
#: Chunks of which a worker keeps the ids, twice.
CACHE = 250_000
#: Texts are cut in front of every run of blanks: no token of either side crosses such a place.
CHUNKS = re.compile(" +[^ ]*|[^ ]+")
#: Fixed value: the split of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the definition must say for that: blanks are parted from what stands before them, and nothing is normalised.
PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE tokenizer of the tokenizers library; the strings of special tokens are plain text."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        said, of = json.loads(definition), byte_characters()
        if said["normalizer"] is not None or any((said["pre_tokenizer"] or {}).get(k) != v for k, v in PLAIN.items()):
            raise ValueError("needs the byte-level split and no normaliser")
        vocabulary = said["model"]["vocab"] | {t["content"]: t["id"] for t in said["added_tokens"]}
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_of[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()

        # Where ids ascend in the order of the merges, they are the ranks of the quicker library, which merges the pair of least rank.
        merges = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in said["model"]["merges"]]
        known = said["model"]["vocab"].values()
        self.ranked = None
        if all(a < b for a, b in zip(merges, merges[1:], strict=False)) and len(merges) + 256 == len(known):
            from tiktoken import Encoding

            self.ranked = Encoding("alignment", pat_str=SPLIT, mergeable_ranks={self.bytes_of[i]: i for i in known}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return list(map(self.ranked.encode_ordinary, texts))
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pair:
    """Both tokenizers, the byte lengths of their ids, and the ids' decimal strings with what follows them in a list of groups."""

    def __init__(self, a: str, b: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.a, self.b, self.library = ByteLevel(a), Model(b), SentencePieceProcessor(model_proto=b)
        if self.b.map.units or self.b.squeeze or not self.b.prefix:
            raise ValueError("needs a model that adds a blank in front and changes nothing else")
        self.bytes_of = [self.a.bytes_of, self.b.bytes_of]
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in self.bytes_of]
        self.n_a, self.n_b = map(len, self.bytes_of)
        self.kind = "<u2" if max(self.n_a, self.n_b) <= 1 << 16 else "<u4"
        self.strings = [f"{i}{end}" for n, last in ((self.n_a, "|"), (self.n_b, ";")) for end in (",", last) for i in range(n)]
        #: Ids of chunks as bytes, of each side; None where either side's bytes aren't the chunk's.
        self.known: tuple[dict[str, bytes | None], dict[str, bytes | None]] = ({}, {})
        self.older: tuple[dict[str, bytes | None], dict[str, bytes | None]] = ({}, {})

    @classmethod
    def of(cls, shared) -> Pair:
        """One for each worker process, kept over its tasks."""
        a, b = shared.value
        key = hash((a, b))
        if key not in _PAIRS:
            _PAIRS.clear()
            _PAIRS[key] = cls(a, b)
        return _PAIRS[key]

    def _chunks(self, new: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """Ids of both sides as bytes of each chunk; None where either side's bytes aren't the chunk's.

        Every chunk begins with a blank, which B's library adds itself; one of blanks alone would be empty to it.
        """
        word = "H" if self.kind == "<u2" else "I"
        one, two = (side.__getitem__ for side in self.bytes_of)
        for chunk, a, b in zip(new, self.a.encode(new), self.library.encode([c[1:] for c in new], num_threads=1), strict=True):
            if not chunk.strip(" "):
                b = self.b.pieces(chunk.replace(" ", MARK))
            data = chunk.encode()
            good = b"".join(map(one, a)) == data and b"".join(map(two, b)) == data
            yield (array(word, a).tobytes(), array(word, b).tobytes()) if good else None

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides of each text as bytes; None for an empty text and where the bytes of either side aren't a space and the text."""
        chunks = [CHUNKS.findall(" " + t) if t else [] for t in texts]
        if len(self.known[0]) > CACHE:
            self.older, self.known = self.known, ({}, {})
        (a, b), (older_a, older_b) = self.known, self.older
        missing = list(set().union(*chunks) - a.keys())
        new = []
        for c in missing:
            if c in older_a:
                a[c], b[c] = older_a[c], older_b[c]
            else:
                new.append(c)
        for c, ids in zip(new, self._chunks(new), strict=True):
            a[c], b[c] = ids or (None, None)
        out: list[tuple[bytes, bytes] | None] = []
        for own in chunks:
            try:
                out.append((b"".join(map(a.__getitem__, own)), b"".join(map(b.__getitem__, own))) if own else None)
            except TypeError:  # a chunk without ids
                out.append(None)
        for c in missing:
            if len(c) > 64:
                del a[c], b[c]
        return out


_PAIRS: dict[int, Pair] = {}


def events(df: DataFrame, shared, id_column: str, text_column: str) -> DataFrame:
    """id, doc, at, side, ids: for each document a first event (at -1, side: how many rows it stands for), then blocks of the ends of tokens: ``at`` is the byte where the block's first token begins.

    Rows that agree in id and text are put together in each batch of a task before anything is shuffled, so a third of all rows that are one row go on as a few.
    """

    def work(columns: list[list]) -> Iterator[list]:
        pair = Pair.of(shared)
        size = BLOCK * np.dtype(pair.kind).itemsize
        copies = Counter(zip(*columns[:2], strict=True))
        texts = dict(zip(zip(*columns[:2], strict=True), columns[2], strict=True))
        keys = list(texts)
        for at in range(0, len(keys), 250):
            part = keys[at : at + 250]
            out: list[list] = [[], [], [], [], []]
            for (key, doc), both in zip(part, pair.encode([texts[k] for k in part]), strict=True):
                rows = [(-1, copies[key, doc], b"")]
                for side, data in enumerate(both or ()):
                    ends = np.cumsum(pair.lengths[side][np.frombuffer(data, pair.kind)]) if len(data) > size else ()
                    rows += [(int(ends[k * BLOCK - 1]) if k else 0, side, data[k * size : (k + 1) * size]) for k in range(-(-len(data) // size))]
                for row in rows:
                    for column, value in zip(out, (key, doc, *row), strict=True):
                        column.append(value)
            yield out

    source = df.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text")).withColumn("doc", F.xxhash64("text"))
    return map_batches(source, ["id", "doc", "text"], work, "id bigint, doc bigint, at bigint, side int, ids binary")


class Machine:
    """The state of the sweep within one document."""

    def __init__(self, pair: Pair, key: tuple, digest: bool) -> None:
        self.pair, self.key, self.digest = pair, key, digest
        self.copies = self.part = 0
        self.seen: list[int] = [-1, -1]
        #: Tokens since the last common end, and the byte where they begin, on each side.
        self.ids = [[], []]
        self.opened = [0, 0]
        self.sha, self.first = hashlib.sha256(), True
        self.sums = np.zeros(4, np.int64)  # tokens of both sides, groups, links
        self.links: list[np.ndarray] = []
        self.n_links = 0
        self.text: list[str] = []

    def event(self, at: int, side: int, data: bytes) -> None:
        if at < 0:
            self.copies += side
        elif at > self.seen[side]:  # the blocks of a document that another batch has too stand beside its first ones
            self.seen[side] = at
            self.ids[side].append(np.frombuffer(data, self.pair.kind).astype(np.int64))

    def sweep(self) -> None:
        """Closes all groups that end by now, and keeps what is open."""
        if not self.ids[0] or not self.ids[1]:
            return
        pair = self.pair
        a, b = (x[0] if len(x) == 1 else np.concatenate(x) for x in self.ids)
        a_ends = np.cumsum(pair.lengths[0][a]) + self.opened[0]
        b_ends = np.cumsum(pair.lengths[1][b]) + self.opened[1]
        there = np.searchsorted(b_ends, a_ends)
        hit = b_ends[np.minimum(there, len(b_ends) - 1)] == a_ends
        ka = np.flatnonzero(hit)
        kb = there[ka]
        if not len(ka):
            self.ids = [[a], [b]]
            return
        na, nb = int(ka[-1]) + 1, int(kb[-1]) + 1
        self.sums += (na, nb, len(ka), len(ka))
        self.links.append(a[ka] * pair.n_b + b[kb])
        self.n_links += len(ka)
        # Tokens in the order of the groups, those of A first in each: a token's place is its number and that of the other side's tokens before it.
        before = np.concatenate([[0], kb[:-1] + 1])
        codes = np.empty(na + nb, np.int64)
        a_codes, b_codes = a[:na].copy(), b[:nb] + 2 * pair.n_a
        a_codes[ka] += pair.n_a
        b_codes[kb] += pair.n_b
        codes[np.arange(na) + np.repeat(before, np.diff(ka, prepend=-1))] = a_codes
        codes[np.arange(nb) + np.repeat(ka + 1, np.diff(kb, prepend=-1))] = b_codes
        groups = "".join(map(pair.strings.__getitem__, codes.tolist()))[:-1]
        if self.digest:
            self.sha.update(groups.encode() if self.first else b";" + groups.encode())
        else:
            self.text.append(groups)
        self.first = False
        self.opened = [int(a_ends[ka[-1]])] * 2
        self.ids = [[a[na:]] if na < len(a) else [], [b[nb:]] if nb < len(b) else []]

    def row(self, last: bool) -> tuple:
        """What the document has given since the last row of it."""
        pairs, counts = np.unique(np.concatenate(self.links), return_counts=True) if self.links else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        groups = ";".join(self.text) if not self.digest else (self.sha.hexdigest() if not self.first else "") if last else None
        out = (*self.key, self.copies, self.part, *self.sums.tolist(), groups, pairs.astype("<i8" if self.pair.n_a * self.pair.n_b >= 1 << 32 else "<u4").tobytes(), counts.astype("<u4").tobytes())
        self.part += 1
        self.sums[:] = 0
        self.links, self.n_links, self.text = [], 0, []
        return out


SWEPT = "id bigint, doc bigint, copies int, part int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, counts binary"


def swept(df: DataFrame, a_definition: str, b_model: bytes, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """Groups and links of every document, in parts of bounded size.

    Columns: id, doc (hash of the text), copies (rows with this id and text), part, then of each part n_a, n_b, n_groups, n_links, groups
    (``a1,a2|b1;a3|b2,b3``: ids of A and B of each group; with ``digest`` the SHA-256 of all parts joined by ``;`` in the last part), pairs and counts (the
    distinct linked pairs, as id of A times the size of B's vocabulary plus id of B, and how often each is linked). Documents without tokens have one part of zeros and ''.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((a_definition, b_model))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SWEPT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(shared)
        at: Machine | None = None
        for batch in batches:
            out: list[tuple] = []
            for key, doc, offset, side, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at.key != (key, doc):
                    if at is not None:
                        at.sweep()
                        out.append(at.row(True))
                    at = Machine(pair, (key, doc), digest)
                at.event(offset, side, data)
                if len(at.ids[0]) + len(at.ids[1]) > 8:
                    at.sweep()
                    if at.n_links > PART:
                        out.append(at.row(False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if at is not None:
            at.sweep()
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(at.row(True), schema.types, strict=True)], schema=schema)

    dealt = events(df, shared, id_column, text_column).repartition(partitions(spark), "id", "doc").sortWithinPartitions("id", "doc", "at", "side")
    return dealt.mapInArrow(run, SWEPT)


def _links(pairs: bytes, counts: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(pairs, "<i8" if wide else "<u4").astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64)


def pair_counts(parts: DataFrame, wide: bool) -> DataFrame:
    """pair, n: how many links of the corpus hold each pair; a task sums what it reads before it hands on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], names=["pair", "n"])

        for batch in batches:
            for pairs, counts, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, n = _links(pairs, counts, wide)
                held.append((p, n * copies))
                size += len(p)
                if size > 1 << 22:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1 << 21:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged())

    return parts.select("pairs", "counts", "copies").mapInArrow(work, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment(df: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, n_a, n_b, n_groups, n_links, n_best, count_sum long and groups_sha256 string of each row.

    A encodes a space and the text, B the text. A pair's count is the number of links in the corpus that hold it; n_best counts a document's links
    whose count is the highest of their id of B, and count_sum sums the counts over its links. Null and empty texts, and those whose tokens of either side don't
    spell a space and the text, have zeros and ''. Ids may be null or repeat; each row is a result, and rows that agree in id and text have their
    links counted each. Other columns aren't read. The vocabularies are read on the driver and broadcast; their size is fixed.
    """
    spark = df.sparkSession
    with open(a_path, encoding="utf-8") as file:
        a_definition = file.read()
    with open(b_path, "rb") as file:
        b_model = file.read()
    pair = Pair(a_definition, b_model)
    n_b, wide = pair.n_b, pair.n_a * pair.n_b >= 1 << 32
    parts = written(swept(df, a_definition, b_model, id_column, text_column, digest=True), "swept")
    counts = written(pair_counts(parts, wide), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # One row for each id of B at most, and fewer than FREQUENT pairs.
    best = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("most"))
    most = np.zeros(n_b, np.int64)
    for r in best.collect():
        most[r.b] = r.most
    frequent = counts.where(F.col("n") * FREQUENT > total).sort("pair").toArrow()
    known = spark.sparkContext.broadcast((frequent["pair"].to_numpy(), frequent["n"].to_numpy(), most))

    def score(columns: list[list]) -> Iterator[list]:
        keys, values, top = known.value
        out: list[list] = [[], [], [], []]
        for pairs, counts_ in zip(*columns[-2:], strict=True):
            p, n = _links(pairs, counts_, wide)
            place = np.minimum(np.searchsorted(keys, p), max(len(keys) - 1, 0))
            here = keys[place] == p if len(keys) else np.zeros(len(p), bool)
            count = values[place[here]]
            out[0].append(int(n[here][count == top[p[here] % n_b]].sum()))
            out[1].append(int((n[here] * count).sum()))
            out[2].append(p[~here])
            out[3].append(n[~here])
        ends = pa.array(np.cumsum([0, *map(len, out[2])]), pa.int32())
        rare = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *c]))) for c in out[2:]]
        yield [*columns[:-2], out[0], out[1], *rare]

    names = ["id", "doc", "copies", "n_a", "n_b", "n_groups", "n_links", "groups"]
    kinds = {"copies": "int", "groups": "string"}
    schema = ", ".join([f"{c} {kinds.get(c, 'bigint')}" for c in names]) + ", n_best bigint, count_sum bigint, rare array<bigint>, times array<bigint>"
    scored = written(map_batches(parts, [*names, "pairs", "counts"], score, schema), "scored")
    # Links of pairs that aren't frequent find their counts by a join: none has more than 1 / FREQUENT of all links.
    rare = scored.select("id", "doc", F.explode(F.arrays_zip("rare", "times")).alias("link")).select("id", "doc", F.col("link.rare").alias("pair"), F.col("link.times").alias("times"))
    tops = F.broadcast(best.withColumnRenamed("b", "of_b"))
    flagged = counts.join(tops, counts.pair % n_b == tops.of_b).select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    late = rare.join(flagged, "pair").groupBy("id", "doc").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = lambda kind: F.lit(None).cast(kind)
    sums = ["n_a", "n_b", "n_groups", "n_links"]
    both = scored.select("id", "doc", "copies", *sums, "groups", "n_best", "count_sum").unionByName(late.select("id", "doc", none("int").alias("copies"), *[none("long").alias(c) for c in sums], none("string").alias("groups"), "n_best", "count_sum"))
    total_of = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    whole = both.groupBy("id", "doc").agg(F.max("copies").alias("copies"), *[total_of(c) for c in (*sums, "n_best", "count_sum")], F.max("groups").alias("groups_sha256"))
    return whole.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(F.col("id").alias(id_column), *sums, "n_best", "count_sum", "groups_sha256")
