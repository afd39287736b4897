"""Removal of repeated byte windows: a depth-limited radix sort of suffixes by most-significant digits.

Suffixes are ordered only through their first ``length`` bytes, digit by digit from the front; a group that holds one
suffix is done, and the groups that are left after the last digit are exactly the repeated windows.

To keep the passes from shuffling every suffix, the first digit is drawn from content: each window is dealt by its
anchor, the gram of ``GRAM`` bytes with the least hash in it (leftmost of equals). Equal windows have equal anchors at
the same place, so no pair is lost, and a run of windows with one anchor travels as one string of bytes. The passes:

1. anchors. Documents are dealt to batches; a batch sends the hashes of its anchors (48 bits, each once, with the number of
   different runs at it) to buckets by range of hash, and gets back a bit for each that stands in two documents at least. A
   false positive of a hash only costs work.
2. runs. For these anchors a batch sends each distinct run of windows once, with the smallest id that has it.
3. windows. A bucket's first pass is over the anchors: where one distinct run is left at an anchor, its windows have no
   company but their copies and are done. The windows of all other runs go through the passes over digits of eight bytes
   (of 3.9 million windows sent for 10,000 test documents 54 %). A batch gets back, for each run, a bit for each
   window that a smaller id has, too.

What a batch sends for one anchor or run is bounded by its own size however often it repeats. An anchor with more than
``HOT_RUNS`` different runs in all batches (a short string between ever different neighbours) is hot: its windows aren't sent as
runs but one by one, each with its smallest id in the batch, to buckets by the hash of the window. So neither an anchor nor a
string that a third of all documents share makes a large group. The three passes over documents each deal them to the same
batches, which is a shuffle of the texts each time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import partitions, text_or_empty, written

GRAM = 20
#: Bytes of text in a batch, about; there are at least as many batches as shuffle partitions.
BATCH_BYTES = 64 << 20
DIGIT = 8
HOT_RUNS = 4096
#: Occurrences of an anchor in a batch from which its different runs are counted; fewer count as they are.
COUNTED = 8
NULL_ID = -(1 << 63)
#: Bytes of texts whose removed bytes are worked out together.
TOGETHER = 2 << 20
RESULT = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes (8 at least) from each position that has so many: its eight-byte words by odd multipliers, mixed."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # Eight bytes from each position as a number.
    eight = np.empty(len(data) - 7, dtype=np.uint64)
    for at in range(8):
        part = eight[at::8]
        part[:] = data[at : at + 8 * len(part)].view("<u8")
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, at in enumerate([*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]):
        h += eight[at : at + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 3)) & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(32)
    return _mix(h)


def window_anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the position of its least one by the upper 32 bits, leftmost of equals.

    Hash and position share a number, so minima over windows come by doubling their width.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least, step = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while step < width:
        move = min(step, width - step)
        least = np.minimum(least[: len(least) - move], least[move:])
        step += move
    return (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Runs:
    """Runs of windows with one anchor in texts: number of the text, first window in it, number of windows, hash of the anchor (48 bits), hash of its first and last gram."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        parts, at = [], 0
        while at < len(texts):
            # About a megabyte at once, as one string; windows across a boundary are left out.
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= 1 << 20:
                size += len(texts[end])
                end += 1
            parts.append(self._of(texts[at:end], at, length))
            at = end
        self.text, self.first, self.count, self.hash, self.ends = (np.concatenate([np.zeros(0, t), *[p[k] for p in parts]]) for k, t in enumerate((np.int64, np.int64, np.int64, np.uint64, np.uint64)))

    @staticmethod
    def _of(texts: list[bytes], number: int, length: int) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        ends = begins + np.maximum(sizes - length + 1, 0)  # behind the last window of each text
        h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
        anchors = window_anchors(h, length - GRAM + 1)
        some = ends > begins
        if not some.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        inside = np.zeros(len(anchors) + 1, np.int8)
        inside[begins[some]] = 1
        inside[ends[some]] -= 1
        new = np.ones(len(anchors), bool)
        np.not_equal(anchors[1:], anchors[:-1], out=new[1:])
        new[begins[some]] = True
        new = np.flatnonzero(new & np.cumsum(inside[:-1], dtype=np.int8).view(bool))
        owner = np.searchsorted(begins, new, side="right") - 1
        count = np.minimum(np.append(new[1:], len(anchors)), ends[owner]) - new
        ends_ = h[new] * np.uint64(3) + h[new + count - 1 + length - GRAM]
        return owner + number, new - begins[owner], count, h[anchors[new]] >> np.uint64(16), ends_


def repeated_windows(windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest of ``ids`` for equal rows of ``windows`` (bytes), at each row: most-significant-digit passes over the rows that still have company."""
    out = ids.copy()
    n, length = windows.shape
    group, live = np.zeros(n, dtype=np.int64), np.arange(n)
    for at in range(0, length, DIGIT):
        digit = np.zeros((len(live), 8), np.uint8)
        part = windows[live, at : at + DIGIT]
        digit[:, : part.shape[1]] = part
        key = digit.view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((key, group))
        g, k = group[order], key[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        name = np.cumsum(new) - 1
        company = np.bincount(name)[name] > 1
        live, group = live[order[company]], name[company]
        if not len(live):
            return out
    order = np.argsort(group, kind="stable")
    live, group = live[order], group[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(ids[live], starts)
    out[live] = np.repeat(least, np.diff(np.append(starts, len(live))))
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a 48-bit hash, by range of a mixed copy (the least hashes of windows are small)."""
    return ((_mix(h) >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(48)).astype(np.int64) if buckets <= 1 << 16 else (_mix(h) % np.uint64(buckets)).astype(np.int64)


def _texts(table: pa.Table) -> list[tuple[int, bytes]]:
    """Ids and texts of a batch, in an order that every pass finds again."""
    keys = [NULL_ID if k is None else k for k in table.column("key").to_pylist()]
    return sorted(zip(keys, table.column("text").cast(pa.binary()).to_pylist(), strict=True))


def _batch_anchors(texts: list[tuple[int, bytes]], length: int, buckets: int, counting: bool = False) -> tuple[Runs, list[np.ndarray], np.ndarray, np.ndarray]:
    """The runs of a batch; for each bucket the distinct anchors in order; for each anchor (all buckets in line) whether it has two ids here, and with ``counting`` how many different runs."""
    runs = Runs([t for _, t in texts], length)
    ids = np.array([k for k, _ in texts], np.int64)[runs.text]
    order = np.lexsort((ids, runs.hash))
    hashes, ids = runs.hash[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(hashes))[: len(starts)]
    distinct, several = hashes[starts], ids[starts] != ids[ends - 1]
    number = ends - starts
    if counting:
        runs_ends = runs.ends[order]
        for k in np.flatnonzero(number >= COUNTED).tolist():
            number[k] = len(np.unique(runs_ends[starts[k] : ends[k]]))
    bucket = _bucket(distinct, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return runs, [distinct[order[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)], several[order], number[order]


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _isin(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x if len(sorted_) else np.zeros(len(x), bool)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many numbers from each start on, in line."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class _Chosen:
    """The distinct runs of a batch whose anchors are repeated, in an order that every pass finds again; text, run, first and count: the places that have them, in order of the text."""

    def __init__(self, texts: list[tuple[int, bytes]], runs: Runs, repeated: np.ndarray, hot: np.ndarray, length: int, buckets: int) -> None:
        pick = np.flatnonzero(_isin(repeated, runs.hash))
        alone = _isin(hot, runs.hash[pick])
        # A window has one anchor wherever it stands, so it is sent by itself in all batches or in none.
        times = np.where(alone, runs.count[pick], 1)
        again = np.repeat(np.arange(len(pick)), times)
        self.text = runs.text[pick][again]
        self.first = _ragged(runs.first[pick], times)
        self.count = np.where(alone, 1, runs.count[pick])[again]
        known: dict[bytes, int] = {}
        put, size, data = known.setdefault, known.__len__, [t for _, t in texts]
        ends = self.first + self.count + (length - 1)
        self.run = np.array([put(data[k][a:b], size()) for k, a, b in zip(self.text.tolist(), self.first.tolist(), ends.tolist(), strict=True)], np.int64)
        self.bytes = list(known)
        self.windows = np.array(list(map(len, self.bytes)), np.int64) - (length - 1)
        _, at = np.unique(self.run, return_index=True)
        self.least = np.array([k for k, _ in texts], np.int64)[self.text[at]]  # texts come in order of id
        self.hash = runs.hash[pick][again][at]
        for k in np.flatnonzero(alone[again[at]]).tolist():
            self.hash[k] = xxhash.xxh64_intdigest(self.bytes[k]) >> 16
        self.bucket = _bucket(self.hash, buckets)
        self._order = np.argsort(self.bucket, kind="stable")
        self._sorted = self.bucket[self._order]

    def of(self, bucket: int) -> np.ndarray:
        """The runs of a bucket; all buckets together are one sort."""
        return self._order[slice(*np.searchsorted(self._sorted, [bucket, bucket + 1]))]


def _resolve(hashes: np.ndarray, ids: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest id that has each window of the distinct runs, in line; for each run where its windows begin there, and how many they are."""
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(p, len(known)) for p in pieces], np.int64)
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    rep = np.zeros(len(known), np.int64)
    rep[number] = np.arange(len(pieces))
    distinct = list(known)
    lengths = np.array(list(map(len, distinct)), np.int64)
    sizes = lengths - length + 1
    offsets = np.cumsum(sizes) - sizes
    anchors = hashes[rep]
    order = np.argsort(anchors, kind="stable")
    same = np.concatenate([[False], anchors[order][1:] == anchors[order][:-1]])
    company = np.zeros(len(distinct), bool)
    company[order] = same | np.append(same[1:], False)
    out = np.repeat(least, sizes)
    # Anchors in order, in blocks of bounded size.
    chosen = order[company[order]]
    totals, anchors = np.cumsum(sizes[chosen]), anchors[chosen]
    at = 0
    while at < len(chosen):
        # As many runs as reach the bound, and the others of the last one's anchor.
        end = int(np.searchsorted(totals, (totals[at - 1] if at else 0) + 2_000_000)) + 1
        end = int(np.searchsorted(anchors, anchors[min(end, len(chosen)) - 1], side="right"))
        part = chosen[at:end]
        flat = np.frombuffer(b"".join([distinct[k] for k in part.tolist()]), np.uint8)
        starts = _ragged(np.cumsum(lengths[part]) - lengths[part], sizes[part])
        windows = np.lib.stride_tricks.sliding_window_view(flat, length)[starts]
        out[_ragged(offsets[part], sizes[part])] = repeated_windows(windows, np.repeat(least[part], sizes[part]))
        at = end
    return out, offsets[number], sizes[number]


def _without(texts: list[tuple[int, bytes]], places: tuple[np.ndarray, ...], length: int) -> pa.Table:
    """Rows of ``RESULT`` for texts; places: number of the text, first byte of a run of repeated windows in it, and how many they are."""
    sizes = np.array([len(t) for _, t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    text, first, count = places
    starts = base[text] + first
    flat = np.frombuffer(b"".join([t for _, t in texts]), np.uint8)
    n = len(flat)
    marks = np.bincount(starts, minlength=n + 1) - np.bincount(starts + count + (length - 1), minlength=n + 1)
    gone = np.cumsum(marks)[:n] > 0
    # Spans end with their text.
    begin, end = gone.copy(), gone.copy()
    begin[1:] &= ~gone[:-1]
    end[:-1] &= ~gone[1:]
    some = sizes > 0
    begin[base[some]] = gone[base[some]]
    last = (base + sizes - 1)[some]
    end[last] = gone[last]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    owner = np.searchsorted(base, begin, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(x - base[owner], pa.int32()) for x in (begin, end)], names=["start", "end"])
    edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    left = np.concatenate([[0], np.cumsum(~gone)])[np.append(base, n)]
    kept = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(left.astype("<i4").tobytes()), pa.py_buffer(flat[~gone].tobytes())])
    return pa.Table.from_arrays([pa.array([None if k == NULL_ID else k for k, _ in texts], pa.int64()), pa.array(sizes), kept, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans)], schema=RESULT)


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 50, buckets: int | None = None, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Removes each byte of a text covered by a ``length``-byte string that also starts in a document with a smaller id.

    Returns id_column, n_bytes, kept binary (the remaining bytes) and spans array<struct<start int, end int>> (maximal
    removed runs in bytes of the input). A null text is empty. A null id is smaller than any other; rows of equal id are
    one document to each other, so they remove nothing from each other. Other columns are not read.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_column).cast("long").alias("key"), text_or_empty(text_column).alias("text"))
    n = buckets or max(partitions(spark), -(-(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BATCH_BYTES))
    docs = source.withColumn("batch", F.pmod(F.xxhash64("key", "text"), F.lit(n)).cast("int")).repartition(n, "batch")
    squeeze = lambda b: zstandard.ZstdCompressor(level=3).compress(b)

    def pass1(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        _, parts, several, number = _batch_anchors(_texts(table), length, n, True)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        several, number = np.split(several, cuts), np.split(number, cuts)
        some = [k for k, p in enumerate(parts) if len(p)]
        # Numbers of runs: places and numbers of the anchors with more than one.
        more = [(np.flatnonzero(number[k] > 1), number[k]) for k in some]
        counts = [squeeze(np.concatenate([at, c[at]]).astype("<u4").tobytes()) for at, c in more]
        return pa.table({"batch": pa.array([batch] * len(some), pa.int32()), "bucket": pa.array(some, pa.int32()), "anchors": pa.array([_pack48(parts[k]) for k in some], pa.binary()), "several": pa.array([np.packbits(several[k]).tobytes() for k in some], pa.binary()), "runs": pa.array(counts, pa.binary())})

    def pass1_bucket(table: pa.Table) -> pa.Table:
        wide = zstandard.ZstdDecompressor()
        parts = [_unpack48(x.as_py()) for x in table.column("anchors")]
        flags = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("several"), parts, strict=True)]
        numbers = [np.ones(len(p), np.int64) for p in parts]
        for number, x in zip(numbers, table.column("runs"), strict=True):
            at, count = np.frombuffer(wide.decompress(x.as_py()), "<u4").reshape(2, -1)
            number[at] = count
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        hot = flat[starts][np.add.reduceat(np.concatenate(numbers)[order], starts) > hot_runs]
        twice = np.unique(np.concatenate([flat[1:][flat[1:] == flat[:-1]], *[p[f] for p, f in zip(parts, flags, strict=True)]]))
        found = [_isin(twice, p) for p in parts]
        keep = [k for k, f in enumerate(found) if f.any()]
        bits = lambda of: pa.array([np.packbits(of(k)).tobytes() for k in keep], pa.binary())
        return pa.table({"batch": table.column("batch").take(pa.array(keep, pa.int64())), "bucket": table.column("bucket").take(pa.array(keep, pa.int64())), "bits": bits(lambda k: found[k]), "hot": bits(lambda k: _isin(hot, parts[k])) if len(hot) else pa.array([None] * len(keep), pa.binary())})

    def chosen(texts: list[tuple[int, bytes]], marks: pa.Table) -> _Chosen:
        runs, parts, _, _ = _batch_anchors(texts, length, n)
        buckets_ = marks.column("bucket").to_pylist()

        def marked(column: str) -> np.ndarray:
            bits = [(b, np.unpackbits(np.frombuffer(x, np.uint8), count=len(parts[b])).astype(bool)) for b, x in zip(buckets_, marks.column(column).to_pylist(), strict=True) if x is not None]
            return np.sort(np.concatenate([np.zeros(0, np.uint64), *[parts[b][f] for b, f in bits]]))

        return _Chosen(texts, runs, marked("bits"), marked("hot"), length, n)

    def pass2(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"batch": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "anchors": pa.array([], pa.binary()), "ids": pa.array([], pa.binary()), "sizes": pa.array([], pa.binary()), "pieces": pa.array([], pa.binary())})
        batch = table.column("batch")[0].as_py()
        c = chosen(_texts(table), marks)
        rows = []
        for bucket in np.unique(c.bucket).tolist():
            mine = c.of(bucket)
            pieces = [c.bytes[k] for k in mine]
            rows.append((bucket, _pack48(c.hash[mine]), squeeze(c.least[mine].astype("<i8").tobytes()), np.array([len(p) for p in pieces], "<u4").tobytes(), squeeze(b"".join(pieces))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table({"batch": pa.array([batch] * len(rows), pa.int32()), "bucket": pa.array(columns[0], pa.int32()), **{name: pa.array(col, pa.binary()) for name, col in zip(("anchors", "ids", "sizes", "pieces"), columns[1:], strict=True)}})

    def pass3(table: pa.Table) -> pa.Table:
        wide, hashes, ids, pieces = zstandard.ZstdDecompressor(), [], [], []
        for a, i, s, p in zip(*(table.column(x).to_pylist() for x in ("anchors", "ids", "sizes", "pieces")), strict=True):
            hashes.append(_unpack48(a))
            ids.append(np.frombuffer(wide.decompress(i), "<i8"))
            flat, at = wide.decompress(p), 0
            for size in np.frombuffer(s, "<u4").tolist():
                pieces.append(flat[at : at + size])
                at += size
        owners = np.concatenate(ids)
        least, begins, counts = _resolve(np.concatenate(hashes), owners, pieces, length)
        out, at = [], 0
        for i in ids:
            mine = counts[at : at + len(i)]
            bits = least[_ragged(begins[at : at + len(i)], mine)] < np.repeat(i, mine)
            out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            at += len(i)
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "bits": pa.array(out, pa.binary())})

    def pass4(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        texts = _texts(table)
        c = chosen(texts, marks.filter(pc.equal(marks.column("stage"), 1)))
        second = marks.filter(pc.equal(marks.column("stage"), 2))
        # A bit for each window of the distinct runs, in line: another batch has it with a smaller id.
        begins = np.cumsum(c.windows) - c.windows
        answers = np.zeros(int(c.windows.sum()), bool)
        for bucket, bits in zip(second.column("bucket").to_pylist(), second.column("bits").to_pylist(), strict=True):
            mine = c.of(bucket)
            places = _ragged(begins[mine], c.windows[mine])
            answers[places] = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(places)).astype(bool)
        ids = np.array([k for k, _ in texts], np.int64)
        out, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at][1])
            while end < len(texts) and size + len(texts[end][1]) <= TOGETHER:
                size += len(texts[end][1])
                end += 1
            here = slice(*np.searchsorted(c.text, [at, end]))
            text, run, first, count = c.text[here], c.run[here], c.first[here], c.count[here]
            # A smaller id of this batch has the whole run; otherwise the bits say which windows one elsewhere has.
            own = c.least[run] < ids[text]
            hit = answers[_ragged(begins[run[~own]], count[~own])]
            number, window = np.repeat(text[~own], count[~own])[hit], _ragged(first[~own], count[~own])[hit]
            places = np.concatenate([text[own], number]) - at, np.concatenate([first[own], window]), np.concatenate([count[own], np.ones(len(window), np.int64)])
            out.append(_without(texts[at:end], places, length))
            at = end
        return pa.concat_tables(out)

    by_batch = docs.groupBy("batch")
    anchors = by_batch.applyInArrow(pass1, "batch int, bucket int, anchors binary, several binary, runs binary")
    marks = anchors.groupBy("bucket").applyInArrow(pass1_bucket, "batch int, bucket int, bits binary, hot binary")
    marks = written(marks, "anchors")
    runs = by_batch.cogroup(marks.groupBy("batch")).applyInArrow(pass2, "batch int, bucket int, anchors binary, ids binary, sizes binary, pieces binary")
    answers = written(runs.groupBy("bucket").applyInArrow(pass3, "batch int, bucket int, bits binary"), "windows")
    both = marks.withColumn("stage", F.lit(1)).unionByName(answers.withColumn("stage", F.lit(2)), allowMissingColumns=True)
    out = by_batch.cogroup(both.groupBy("batch")).applyInArrow(pass4, "key bigint, n_bytes bigint, kept binary, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("key", id_column)


def digest_columns(removed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return removed.select(
        id_column,
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


