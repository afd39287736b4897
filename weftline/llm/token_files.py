"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files. ``shard-N.ids`` is the raw payload: little-endian ids, two bytes each where the vocabulary fits,
else four. ``shard-N.mph`` is the index: a minimal perfect hash, for each document at the slot that the hash gives its key
the offset and length of its ids and a 16-bit fingerprint that turns foreign keys away, then the keys in document order.
The hash is a chain of bitmaps: at each level the keys left hash into twice as many bits as there are keys; a bit that one
key alone has hit holds it, and its slot is the number of bits set before. Every 512 bits of a bitmap have that number
in front of them, so a probe reads one such cell for each level it asks (two on average) and one record, by seeks.

A key is an id and the number of earlier rows with that id (0 for unique ids). Shards are ranges of keys; the manifest, a
row for each shard, has their ends, so a key leads to its shard.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import new_path, partitions, text_or_empty

MAGIC = b"WTOK0002"
LEVELS = 48
GAMMA = 2
CACHE = 400_000
#: What the definition of a tokenizer must say for its words to be encoded one by one.
FIXED = (r'"Lowercase"', r'"NFC"', json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), r'"behavior":"Removed"')
#: The tokenizer's split of a lower-cased text whose characters all lie in Latin-1, where NFC changes nothing; and what lies beyond.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
BEYOND = re.compile(r"[^\x00-\xff]")
BLOCK = struct.Struct("<8sQQHHI")  # magic, documents, tokens, bytes of an id, levels, keys kept in a list
#: Bytes of bitmap in a cell, which begins with the number of bits set before it (eight bytes).
CELL = 64
RECORD = np.dtype([("offset", "<u8"), ("length", "<u8"), ("print", "<u2")])
MANIFEST = "shard int, n_docs bigint, n_tokens bigint, first_key bigint, n_first bigint, last_key bigint, n_last bigint"
NULL_KEY = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(ids: np.ndarray, nth: np.ndarray, level: int) -> np.ndarray:
    """64-bit hashes of keys (id, nth), independent for each level."""
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return _mix(_mix(ids.astype(np.int64).view(np.uint64) ^ seed) + _mix(nth.astype(np.uint64) + seed))


class PerfectHash:
    """Slots 0..n-1 for n distinct keys."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray) -> None:
        """bits: for each level its bitmap as booleans; rest: rows (id, nth) that no level holds."""
        self.bits, self.rest = bits, rest
        self.before = []
        total = 0
        for b in bits:
            self.before.append(total + np.concatenate([[0], np.cumsum(b)[:-1]]).astype(np.int64))
            total += int(b.sum())
        self.held = total

    @classmethod
    def build(cls, ids: np.ndarray, nth: np.ndarray) -> PerfectHash:
        bits, left = [], np.arange(len(ids))
        while len(left) and len(bits) < LEVELS:
            size = max(8, GAMMA * len(left))
            place = (hashes(ids[left], nth[left], len(bits)) % np.uint64(size)).astype(np.int64)
            hit = np.bincount(place, minlength=size)
            bits.append(hit == 1)
            left = left[hit[place] != 1]
        return cls(bits, np.column_stack([ids[left], nth[left]]).astype(np.int64).reshape(-1, 2))

    def slots(self, ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The slot of each key; for a foreign key any slot or -1."""
        out, left = np.full(len(ids), -1, dtype=np.int64), np.arange(len(ids))
        for level, b in enumerate(self.bits):
            place = (hashes(ids[left], nth[left], level) % np.uint64(len(b))).astype(np.int64)
            hit = b[place]
            out[left[hit]] = self.before[level][place[hit]]
            left = left[~hit]
        for i in left.tolist():
            for k, (a, c) in enumerate(self.rest.tolist()):
                if (a, c) == (int(ids[i]), int(nth[i])):
                    out[i] = self.held + k
        return out

    def dump(self) -> bytes:
        """Numbers of bits of the levels, their cells, and the listed keys."""
        parts = [np.array([len(b) for b in self.bits], "<u8").tobytes()]
        for bits, before in zip(self.bits, self.before, strict=True):
            packed = np.packbits(bits, bitorder="little")
            n = -(-len(packed) // CELL)
            cells = np.zeros((n, 8 + CELL), np.uint8)
            cells[:, :8] = np.ascontiguousarray(before[:: 8 * CELL]).astype("<u8").view(np.uint8).reshape(n, 8)
            flat = np.zeros(n * CELL, np.uint8)
            flat[: len(packed)] = packed
            cells[:, 8:] = flat.reshape(n, CELL)
            parts.append(cells.tobytes())
        return b"".join(parts) + self.rest.astype("<i8").tobytes()

    @classmethod
    def load(cls, data: bytes, at: int, levels: int, rest: int) -> tuple[PerfectHash, int]:
        sizes, at = np.frombuffer(data, "<u8", levels, at).tolist(), at + 8 * levels
        bits = []
        for n in sizes:
            cells = -(-n // (8 * CELL))
            part = np.frombuffer(data, np.uint8, cells * (8 + CELL), at).reshape(cells, 8 + CELL)[:, 8:]
            bits.append(np.unpackbits(part.ravel(), count=n, bitorder="little").astype(bool))
            at += cells * (8 + CELL)
        return cls(bits, np.frombuffer(data, "<i8", 2 * rest, at).reshape(-1, 2)), at + 16 * rest


class ShardWriter:
    """Streams ids into a shard.

    Each try of a task writes files of its own, and gives them their names when both are whole: ids first, the index
    last. A shard's rows and their order follow from the data, so where an earlier try has left a file, that one stays.
    """

    def __init__(self, uri: str, shard: int, width: int) -> None:
        self.files, self.top = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.top, recursive=True)
        self.name, self.try_ = f"{self.top}/shard-{shard:06d}", uuid.uuid4().hex
        self.width, self.tokens = width, 0
        self.out = self.files.open_output_stream(f"{self.name}.ids.{self.try_}")
        self.sizes: list[int] = []
        self.ids: list[int] = []
        self.nth: list[int] = []

    def add(self, key: int, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.nth.append(self.nth[-1] + 1 if self.ids and self.ids[-1] == key else 0)
        self.ids.append(key)
        self.sizes.append(len(ids))
        self.tokens += len(ids)

    def _publish(self, kind: str) -> None:
        own, name = f"{self.name}.{kind}.{self.try_}", f"{self.name}.{kind}"
        there = lambda: self.files.get_file_info(name).type != fs.FileType.NotFound
        if not there():
            try:
                self.files.move(own, name)
                return
            except OSError:
                if not there():
                    raise
        self.files.delete_file(own)

    def close(self) -> None:
        self.out.close()
        ids, nth, sizes = np.array(self.ids, np.int64), np.array(self.nth, np.int64), np.array(self.sizes, np.int64)
        perfect = PerfectHash.build(ids, nth)
        slots = perfect.slots(ids, nth)
        records = np.empty(len(ids), RECORD)
        records["offset"][slots], records["length"][slots] = np.cumsum(sizes) - sizes, sizes
        records["print"][slots] = hashes(ids, nth, LEVELS + 1).astype("<u2")
        head = BLOCK.pack(MAGIC, len(ids), self.tokens, self.width, len(perfect.bits), len(perfect.rest))
        with self.files.open_output_stream(f"{self.name}.mph.{self.try_}") as out:
            out.write(head + perfect.dump() + records.tobytes() + ids.astype("<i8").tobytes() + nth.astype("<i8").tobytes())
        for kind in ("ids", "mph"):
            self._publish(kind)

    def manifest(self, shard: int) -> list:
        """The shard's row of the manifest."""
        ids = np.array(self.ids, np.int64)
        first, last = self.ids[0], self.ids[-1]
        return [shard, len(ids), self.tokens, first, int((ids == first).sum()), last, int((ids == last).sum())]


class Shard:
    """A shard with its whole index in memory, for reading all of it."""

    def __init__(self, uri: str, shard: int) -> None:
        self.files, top = fs.FileSystem.from_uri(uri)
        self.name = f"{top}/shard-{shard:06d}"
        with self.files.open_input_stream(f"{self.name}.mph") as file:
            data = file.read()
        magic, self.n, self.tokens, self.width, levels, rest = BLOCK.unpack_from(data)
        if magic != MAGIC:
            raise ValueError(f"{self.name}.mph is no index of this format")
        self.hash, at = PerfectHash.load(data, BLOCK.size, levels, rest)
        self.records = np.frombuffer(data, RECORD, self.n, at)
        self.ids = np.frombuffer(data, "<i8", self.n, at + RECORD.itemsize * self.n)
        self.nth = np.frombuffer(data, "<i8", self.n, at + (RECORD.itemsize + 8) * self.n)

    def find(self, ids: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and number of ids of each key; -1 and 0 for keys whose fingerprint isn't there."""
        if not self.n:
            return np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        slots = self.hash.slots(ids, nth)
        found = self.records[slots]
        good = (slots >= 0) & (found["print"] == hashes(ids, nth, LEVELS + 1).astype("<u2"))
        return np.where(good, found["offset"].astype(np.int64), -1), np.where(good, found["length"].astype(np.int64), 0)

    def open(self):
        return self.files.open_input_file(f"{self.name}.ids")

    def read(self, file, offset: int, length: int) -> np.ndarray:
        file.seek(offset * self.width)
        return np.frombuffer(file.read(length * self.width), f"<u{self.width}")

    def get(self, key: int, nth: int = 0) -> np.ndarray | None:
        """The ids of a document, None for a foreign key."""
        offset, length = (x[0] for x in self.find(np.array([key]), np.array([nth])))
        if offset < 0:
            return None
        with self.open() as file:
            return self.read(file, int(offset), int(length))


class TokenFiles:
    """Keyed access to the documents of all shards. The manifest (a row for each shard) is held; of the index files each call reads a few cells."""

    def __init__(self, manifest: DataFrame, path: str) -> None:
        self.files, self.top = fs.FileSystem.from_uri(path)
        self.rows = sorted(manifest.select("first_key", "last_key", "shard", "n_docs", "n_first", "n_last").collect())
        self.lasts = [r.last_key for r in self.rows]
        #: Bytes that the last call has read.
        self.bytes_read = 0

    def _at(self, file, place: int, size: int) -> bytes:
        self.bytes_read += size
        file.seek(place)
        return file.read(size)

    def _slot(self, file, levels: list[int], rest: int, key: int, nth: int) -> int:
        at, held = BLOCK.size + 8 * len(levels), 0
        for level, n in enumerate(levels):
            place = int(hashes(np.array([key]), np.array([nth]), level)[0] % np.uint64(n))
            cell, bit = divmod(place, 8 * CELL)
            data = self._at(file, at + cell * (8 + CELL), 8 + CELL)
            bits = int.from_bytes(data[8:], "little")
            if bits >> bit & 1:
                return int.from_bytes(data[:8], "little") + (bits & (1 << bit) - 1).bit_count()
            at += -(-n // (8 * CELL)) * (8 + CELL)
        # No level holds the key: the listed ones come after all others.
        listed = np.frombuffer(self._at(file, at, 16 * rest), "<i8").reshape(-1, 2).tolist()
        return -1 - listed.index([key, nth]) if [key, nth] in listed else 0

    def get(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of the document with this id (the ``nth`` of them); None for one that isn't there, but for one foreign key in 65,536."""
        self.bytes_read = 0
        key = NULL_KEY if key is None else key
        for r in self.rows[bisect.bisect_left(self.lasts, key) :]:
            if r.first_key > key:
                return None
            # Rows of one id may fill several shards; their numbers begin anew in each.
            here = r.n_docs if r.first_key == r.last_key else r.n_first if key == r.first_key else r.n_last if key == r.last_key else None
            if here is not None and nth >= here:
                nth -= here
                continue
            return self._of_shard(r.shard, key, nth)
        return None

    def _of_shard(self, shard: int, key: int, nth: int) -> np.ndarray | None:
        name = f"{self.top}/shard-{shard:06d}"
        with self.files.open_input_file(f"{name}.mph") as file:
            magic, n, _, width, n_levels, rest = BLOCK.unpack(self._at(file, 0, BLOCK.size))
            if magic != MAGIC:
                raise ValueError(f"{name}.mph is no index of this format")
            levels = np.frombuffer(self._at(file, BLOCK.size, 8 * n_levels), "<u8").tolist()
            slot = self._slot(file, levels, rest, key, nth)
            if slot < 0:
                slot = n - rest - 1 - slot
            records = BLOCK.size + 8 * n_levels + sum(-(-b // (8 * CELL)) * (8 + CELL) for b in levels) + 16 * rest
            record = np.frombuffer(self._at(file, records + RECORD.itemsize * slot, RECORD.itemsize), RECORD)[0]
        if record["print"] != hashes(np.array([key]), np.array([nth]), LEVELS + 1).astype("<u2")[0]:
            return None
        with self.files.open_input_file(f"{name}.ids") as file:
            return np.frombuffer(self._at(file, int(record["offset"]) * width, int(record["length"]) * width), f"<u{width}")


_TOKENIZERS: dict[int, tuple] = {}


def word_encoder(definition: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Encodes texts with the word tokenizer: NFC, lower case, words split from marks and digits, white space dropped.

    No token of it crosses white space or the split, so a text is the concatenation of the ids of its words: in a Latin-1
    text those of ``LATIN``, else the parts between blanks. The words met last are kept in two tables of bounded size,
    and the library encodes the others. A tokenizer that works otherwise encodes whole texts.
    """
    key = hash(definition)
    if key not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS.clear()
        _TOKENIZERS[key] = (Tokenizer.from_str(definition), [{}, {}])
    tokenizer, tables = _TOKENIZERS[key]
    if not all(part in definition for part in FIXED):
        return lambda texts: [np.array(e.ids, "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[np.ndarray]:
        words = [LATIN.findall(t.lower()) if "<|" not in t and BEYOND.search(t) is None else t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(tables[0]) > CACHE:
            tables[1], tables[0] = tables[0], {}
        known, older = tables
        known.setdefault("", b"")
        missing, unknown = list(set().union(*words) - known.keys()), []
        for w in missing:
            if (ids := older.get(w)) is None:
                unknown.append(w)
            else:
                known[w] = ids
        for w, e in zip(unknown, tokenizer.encode_batch_fast(unknown, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4") for ws in words]
        for w in missing:
            if len(w) > 64:
                del known[w]
        return out

    return encode


def write_token_files(df: DataFrame, path: str, tokenizer_json: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the ids of every whole text, ``end_id`` after each, to shards below ``path`` (a URI all executors reach) in ascending id order.

    Returns the manifest: shard, n_docs, n_tokens, first and last key and how many rows of the shard have them. Rows are
    dealt to shards by range of id; rows of equal id are ordered by the hash of their texts. A null text is empty (only
    the end id), a null id comes first and has the least integer as its key.
    """
    spark = df.sparkSession
    with open(tokenizer_json, encoding="utf-8") as file:
        definition = file.read()
    shared = spark.sparkContext.broadcast(definition)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_KEY))
    rows = df.select(key.alias("key"), text_or_empty(text_column).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards or partitions(spark), "key", "tie").sortWithinPartitions("key", "tie").select("key", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard, encode = None, 0, word_encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if writer is None:
                    shard = part.column(2)[0].as_py()
                    writer = ShardWriter(path, shard, width)
                for k, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    writer.add(k, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            row = writer.manifest(shard)
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *[pa.array([v], pa.int64()) for v in row[1:]]], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return dealt.mapInArrow(run, MANIFEST)


def read_token_files(manifest: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Reads every document back by its key: id, nth, start, n_tokens, ids_crc32, ids array<int> (null unless ``with_ids``).

    manifest: shard and n_tokens of each shard; start counts the ids of all shards and documents before.
    """
    spark = manifest.sparkSession
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    starts = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base")).repartition(partitions(spark), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path, number)
                with shard.open() as file:
                    for at in range(0, shard.n, 2000):
                        ids, nth = shard.ids[at : at + 2000], shard.nth[at : at + 2000]
                        offsets, lengths = shard.find(ids, nth)
                        found = [shard.read(file, o, n) for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]
                        keys = [None if k == NULL_KEY else k for k in ids.tolist()]
                        yield pa.RecordBatch.from_pydict({
                            "id": pa.array(keys, pa.int64()), "nth": pa.array(nth, pa.int64()), "start": pa.array(base + offsets, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64()),
                            "ids": pa.array([f.tolist() for f in found] if with_ids else [None] * len(found), pa.list_(pa.int32())),
                        })

    return starts.mapInArrow(run, "id bigint, nth bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")


def lookup(manifest: DataFrame, path: str, key: int | None, nth: int = 0) -> np.ndarray | None:
    """Constant-time access to one document's ids by its key, on the driver; ``TokenFiles`` serves many keys."""
    return TokenFiles(manifest, path).get(key, nth)


def new_folder(spark: SparkSession) -> str:
    return new_path(spark, "tokens")
