"""SentencePiece encoding that keeps source offsets, and decoding.

The compiled character map of the model rewrites a text by longest prefix (a model without a map leaves it as it is); each normalised character keeps the bytes
of the original that it came from, and each piece is projected to an original byte span through that alignment.
Pieces are found by merging the adjacent pair with the best score, leftmost first.

No piece of a supported vocabulary has the space mark after another character, so no merge crosses the start of a run
of marks: a text falls apart there into chunks that encode alike wherever they stand, and each worker keeps the pieces
of the chunks that it met last, in two tables of bounded size (``CACHE``).
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import held, map_batches, text_or_empty

MARK = "▁"
CACHE = 250_000
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))


class CharacterMap:
    """Longest-prefix rewriting through a compiled map: a double-array trie over UTF-8 and a pool of null-ended results."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.pool = blob[4 + size :]
        self.known: dict[str, bool] = {}

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``text`` has at ``at``, and its replacement."""
        units, found, node = self.units, None, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]

    def apply(self, text: str) -> tuple[str, list[int] | None]:
        """The rewritten text, and for each of its characters the byte of ``text`` where its source starts (None: unchanged)."""
        if not self.units:
            return text, None
        data, out, starts, at = text.encode(), [], [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                new = data[at : at + size].decode()
            else:
                size, new = hit[0], hit[1].decode()
            out.append(new)
            starts += [at] * len(new)
            at += size
        return "".join(out), [*starts, len(data)]


class Model:
    """A BPE model file with byte fallback, as the library reads it."""

    def __init__(self, data: bytes) -> None:
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.prefix, self.squeeze, self.escape, charsmap = True, True, True, b""
        self.byte_ids: set[int] = set()
        pieces: list[str] = []
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                at = len(self.bytes_of)
                pieces.append(piece)
                if kind == 1:
                    self.score[piece], self.id[piece] = score, at
                    self.bytes_of.append(piece.replace(MARK, " ").encode())
                elif kind == 6:
                    self.byte_id[int(piece[3:-1], 16)] = at
                    self.byte_ids.add(at)
                    self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
                elif kind == 2:
                    self.bytes_of.append(" ⁇ ".encode())
                elif kind == 3:
                    self.bytes_of.append(b"")
                else:
                    raise ValueError("user-defined and unused pieces are not supported")
            elif number == 2:
                if dict(_fields(value)).get(3, 1) != 2:
                    raise ValueError("only BPE models are supported")
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if len(self.byte_ids) != 256 or not self.escape or any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("needs byte fallback, escaped spaces and pieces with marks in front only")
        self.map = CharacterMap(charsmap)
        #: Of each piece: the normalised characters that it stands for, and whether it is a byte that begins (1) or continues (2) one.
        self.advance = np.array([len(b.decode(errors="replace")) for b in self.bytes_of], np.int64)
        self.kind = np.zeros(len(self.bytes_of), np.int8)
        for value, i in enumerate(self.byte_id):
            self.kind[i] = 2 if 0x80 <= value < 0xC0 else 1
            self.advance[i] = self.kind[i] == 1
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """Normalised text, and for each of its characters the start of its source in bytes, with the end last (None: a character per character, behind the added mark)."""
        out, starts = self.map.apply(text)
        if self.squeeze:
            if starts is None:
                starts, at = [], 0
                for c in text:
                    starts.append(at)
                    at += len(c.encode())
                starts.append(at)
            keep = [i for i, c in enumerate(out) if c != " " or (i and out[i - 1] != " ")]
            while keep and out[keep[-1]] == " ":
                keep.pop()
            starts = [starts[i] for i in keep] + [starts[keep[-1] + 1] if keep else 0]
            out = "".join(out[i] for i in keep)
        if out and self.prefix:
            out = " " + out
            starts = starts and [starts[0], *starts]
        return out.replace(" ", MARK), starts

    def _merged(self, chunk: str) -> list[str | None]:
        """The parts of a short chunk: a list of pair scores beside the parts, merged at its first maximum."""
        get, parts = self.score.get, list(chunk)
        none = float("-inf")
        pairs = [get(a + b, none) for a, b in zip(parts, chunk[1:])]
        while pairs and (best := max(pairs)) != none:
            i = pairs.index(best)
            parts[i : i + 2] = [new := parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(new + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + new, none)
        return parts

    def _merged_long(self, chunk: str) -> list[str | None]:
        """The same for a chunk of any length, by a heap over a linked list."""
        score, n = self.score, len(chunk)
        parts: list[str | None] = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := chunk[i : i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := piece + parts[k]) in score:
                    heapq.heappush(heap, (-score[p], i, p))
            if (h := before[i]) >= 0 and (p := parts[h] + piece) in score:
                heapq.heappush(heap, (-score[p], h, p))
        return parts

    def pieces(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk: the best-scored pair is merged until none is left; what is no piece becomes bytes."""
        parts = self._merged(chunk) if len(chunk) <= 20 else self._merged_long(chunk)
        out: list[int] = []
        for p in parts:
            if p is not None:
                if (found := self.id.get(p)) is None:
                    out += [self.byte_id[b] for b in p.encode()]
                else:
                    out.append(found)
        return tuple(out)

    def encode_normalised(self, text: str) -> np.ndarray:
        """Ids (int32) of a normalised text. Each chunk's ids are kept as bytes, so that a text is one join of them."""
        chunks = CHUNKS.findall(text)
        found = list(map(self.cache.get, chunks))
        if None in found:
            if len(self.cache) > CACHE:
                self.older, self.cache = self.cache, {}
            cache, older = self.cache, self.older
            for i, ids in enumerate(found):
                if ids is None:
                    c = chunks[i]
                    found[i] = ids = cache.get(c) or older.get(c) or np.array(self.pieces(c), "<i4").tobytes()
                    if len(c) <= 64:
                        cache[c] = ids
        return np.frombuffer(b"".join(found), "<i4")

    def encode(self, text: str) -> list[int]:
        return self.encode_normalised(self.normalise(text)[0]).tolist()

    def encode_spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the start and end of each piece in the UTF-8 bytes of ``text`` (int32).

        Every piece but a byte piece stands for so many normalised characters; a byte piece that begins a character
        stands for it and those that continue it for none. Running sums give the characters, and the alignment their bytes.
        """
        normal, starts = self.normalise(text)
        ids = self.encode_normalised(normal)
        codes = np.frombuffer(normal.encode("utf-32-le"), "<u4")
        width = 1 + (codes > 0x7F).astype(np.int32) + (codes > 0x7FF) + (codes > 0xFFFF)
        if starts is None:
            # Unchanged but for blanks, which became marks (three bytes for one), and the added mark in front.
            plain = np.frombuffer(text.encode("utf-32-le"), "<u4")
            source = 1 + (plain > 0x7F).astype(np.int32) + (plain > 0x7FF) + (plain > 0xFFFF)
            at = np.zeros(len(codes) + 1, np.int32)
            np.cumsum(source, out=at[len(at) - len(source) :])
        else:
            at = np.array(starts, np.int32)
        end_char = np.cumsum(self.advance[ids], dtype=np.int64)
        begins = self.kind[ids]  # 0: whole characters, 1: the first byte of one, 2: a further byte
        first = end_char - np.maximum(self.advance[ids], begins == 2)
        begin, end = at[first], at[end_char]
        bytes_ = np.flatnonzero(begins)
        if len(bytes_):
            char = first[bytes_]
            # The byte's place in its character; bytes are told apart only where source and character have the same width.
            opens = np.flatnonzero(begins[bytes_] == 1)
            inside = np.arange(len(bytes_)) - opens[np.cumsum(begins[bytes_] == 1) - 1]
            whole = at[char + 1] - at[char] == width[char]
            begin[bytes_] = np.where(whole, at[char] + inside, at[char])
            end[bytes_] = np.where(whole, at[char] + inside + 1, at[char + 1])
        return ids, begin, end

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the library joins it: the added space goes, byte pieces join to characters, broken bytes become U+FFFD each."""
        table = self.bytes_of
        data = b"".join([table[i] for i in ids])
        if self.prefix and data[:1] == b" ":
            first = next((i for i in ids if table[i]), None)
            if first is not None and first not in self.byte_ids:
                data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="each_byte")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def sentencepiece(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", spans: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns id_column, ids array<int>, piece_start and piece_end array<int> (bytes of the text; null if ``spans`` is
    False) and decoded. A null text is empty: no ids, decoded ''. Ids may be null or repeat: each row is one result.
    Other columns are not read. The model file is read on the driver and broadcast; a vocabulary has a fixed size.
    """
    spark = df.sparkSession
    with open(model_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def work(columns: list[list]) -> Iterator[list]:
        model = held(shared, Model)
        for at in range(0, len(columns[0]), 500):
            keys, texts = (c[at : at + 500] for c in columns)
            if spans:
                rows = [model.encode_spans(t) for t in texts]
                ids, starts, ends = (_lists([r[k] for r in rows]) for k in range(3))
            else:
                rows = [(model.encode_normalised(model.normalise(t)[0]),) for t in texts]
                ids, starts, ends = _lists([r[0] for r in rows]), [None] * len(texts), [None] * len(texts)
            yield [keys, ids, starts, ends, [model.decode(r[0].tolist()) for r in rows]]

    source = df.select(F.col(id_column), text_or_empty(text_column).alias("__text"))
    kind = dict(source.dtypes)[id_column]
    return map_batches(source, [id_column, "__text"], work, f"`{id_column}` {kind}, ids array<int>, piece_start array<int>, piece_end array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256, decoded_sha256 and spans_xxh64 (of the starts and ends of all pieces) of ``sentencepiece`` rows, in JVM expressions."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.xxhash64("piece_start", "piece_end").alias("spans_xxh64"),
    )
