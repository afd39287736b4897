"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are sorted by population count and cut into tiles; two tiles are compared by one numpy exclusive-or and bit
count, and skipped where their population counts lie further apart than the radius. A table of up to ``ROWS`` distinct
fingerprints is one set of tiles. A larger one is first dealt to buckets of about so many, without loss (see
``band_buckets`` and ``size_buckets``), so that the tile pairs don't grow as the square of the table; the tiles and their
skipping do all comparing within a bucket. A bucket that is too large for one task is cut into parts whose pairs are tasks
of their own. A tile hands on the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import HOT, delete_path, hot_keys, map_batches, partitions, spread_join, text_or_empty, written, written_at
from weftline.llm.components import components

TILE = 256
ROWS = 4096
PART = 40_000
SEED = 42
# The order of shingles in prefixes: those of a thousandth of the documents come last.
SAMPLE = 5000
COMMON = 5
MOST_COMMON = 200_000
HUBS = 2
SKETCH = 8
#: Most words of 64 bits in a Bloom filter of nodes (8 MB).
BLOOM = 1 << 20
NONE = -(1 << 63)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text's words, A-Z lower-cased, joined by one space, repeats included; fewer words: the whole sequence; none: no hash."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = max(1, len(found) - words + 1)
    ends = starts[min(words, len(found)) :][:n] - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends.tolist(), strict=True)], dtype=np.uint64)


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    """An independent hash of a hash for each lane but the first, which is the hash itself."""
    if lane == 0:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * lane) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 for none."""
    if not len(h):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, lanes: int = 1) -> DataFrame:
    """id_column, lanes array<long> (64 bits each), n_shingles long of each whole text; a null text is empty.

    One lane counts shingles with their repeats. More lanes estimate the similarity of sets, so they and n_shingles are over distinct ones.
    """
    kind = dict(df.dtypes)[id_column]

    def work(columns: list[list]) -> Iterator[list]:
        prints, sizes = [], []
        for text in columns[1]:
            h = shingle_hashes(text, words)
            h = np.unique(h) if lanes > 1 else h
            prints.append(np.array([majority(_mix(h, k)) for k in range(lanes)], dtype=np.uint64).view(np.int64).tolist())
            sizes.append(len(h))
        yield [columns[0], prints, sizes]

    source = df.select(F.col(id_column), text_or_empty(text_column).alias("__text"))
    return map_batches(source, [id_column, "__text"], work, f"`{id_column}` {kind}, lanes array<bigint>, n_shingles bigint")


def _roots(up: np.ndarray) -> np.ndarray:
    while True:
        next_up = up[up]
        if np.array_equal(next_up, up):
            return up
        up = next_up


def _unite(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links i-j."""
    while len(i):
        a, b = up[i], up[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        up = _roots(up)
    return up


def tiles_of(pop: np.ndarray, split: int) -> list[tuple[int, int]]:
    """Tiles of rows in order of population count, cut at ``split`` and where they are full."""
    edges = [*range(0, split, TILE), *range(split, len(pop), TILE), len(pop)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def tile_links(prints: np.ndarray, side: np.ndarray, cross: bool, radius: int, sizes: np.ndarray | None, ratio: float, tally: list[int] | None = None) -> np.ndarray:
    """Root of each row after linking all pairs within ``radius`` bits (prints: rows by lanes).

    side: pairs of two 1s are left to another bucket; with ``cross`` only pairs of a 0 and a 1 count. sizes: only pairs
    whose smaller size is ``ratio`` of the larger at least. tally: is added the pairs of tiles, and those skipped by population count.
    """
    n, lanes = prints.shape
    pop = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    order = np.lexsort((pop, side))
    prints, side, pop = prints[order], side[order], pop[order]
    sizes = None if sizes is None else sizes[order].astype(np.float64)
    up = np.arange(n)
    split = int((side == 0).sum())
    tiles = tiles_of(pop, split)
    first = [np.ascontiguousarray(prints[:, k]) for k in range(lanes)]
    for x, (a, b) in enumerate(tiles):
        for c, d in tiles[x:]:
            one, two = side[a], side[c]
            if one and two or cross and one == two:
                continue
            if tally is not None:
                tally[0] += 1
            if pop[c] - pop[b - 1] > radius or pop[a] - pop[d - 1] > radius:
                if tally is not None:
                    tally[1] += 1
                continue
            if up[a] == up[c] and (up[a:b] == up[a]).all() and (up[c:d] == up[a]).all():
                continue
            apart = np.bitwise_count(first[0][a:b, None] ^ first[0][None, c:d])
            if lanes > 1:
                apart = apart + np.bitwise_count(first[1][a:b, None] ^ first[1][None, c:d])
            i, j = np.nonzero(apart <= radius)
            keep = i + a < j + c if (a, b) == (c, d) else slice(None)
            i, j = i[keep] + a, j[keep] + c
            if lanes > 2 and len(i):
                keep = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= radius
                i, j = i[keep], j[keep]
            if sizes is not None and len(i):
                keep = np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j])
                i, j = i[keep], j[keep]
            up = _unite(up, i, j)
    out = np.empty(n, dtype=np.int64)
    out[order] = order[up]
    return out


def band_buckets(nodes: DataFrame, radius: int) -> DataFrame:
    """Buckets of about ``ROWS`` where any two 64-bit fingerprints within the radius meet: of m bands at least m - radius are equal.

    With up to ``ROWS`` fingerprints there is one bucket. Beyond that a bucket's key is so many bits of the equal bands as
    deal random fingerprints to buckets of that size; when all bits are used, m grows. No choice loses a pair.
    """
    n = nodes.count()
    if n <= ROWS:
        return nodes.select("node", "lanes", "n_shingles", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("side"))
    bits = math.ceil(math.log2(n / ROWS))
    m = next((m for m in range(radius + 1, radius + 5) if 64 // m * (m - radius) >= bits), radius + 4)
    each = min(64 // m, -(-bits // (m - radius)))
    cuts = [round(64 * k / m) for k in range(m)]
    print_ = F.col("lanes")[0]
    bands = [F.shiftrightunsigned(print_, cut).bitwiseAND((1 << each) - 1) for cut in cuts]
    keys = [F.xxhash64(F.lit(i), *[bands[k] for k in chosen]) for i, chosen in enumerate(combinations(range(m), m - radius))]
    return nodes.select("node", "lanes", "n_shingles", F.explode(F.array(*keys)).alias("bucket"), F.lit(0).alias("side"))


def size_buckets(nodes: DataFrame, ratio: float) -> DataFrame:
    """Buckets where any two documents meet whose numbers of shingles are at least in ``ratio``: its own step of a geometric scale and the next one."""
    step = F.floor(F.log(F.greatest(F.col("n_shingles"), F.lit(1)).cast("double")) / -np.log(ratio))
    both = F.array(F.struct(step.alias("bucket"), F.lit(0).alias("side")), F.struct((step + 1).alias("bucket"), F.lit(1).alias("side")))
    return nodes.select("node", "lanes", "n_shingles", F.inline(both))


def _parts(rows: DataFrame) -> DataFrame:
    """Rows with their tasks: a bucket of more than ``PART`` rows becomes g parts, and each pair of parts a task.

    Buckets that are cut have more than 1 / (8 P) of all rows as well, with P shuffle partitions: fewer than 8 P of them, whose counts are broadcast.
    """
    counts = written(rows.groupBy("bucket").count(), "buckets")
    total = counts.agg(F.sum("count")).first()[0] or 0
    large = counts.where(F.col("count") > max(PART, total // (HOT * partitions(rows.sparkSession))))
    cut = rows.join(F.broadcast(large), "bucket", "left")
    g = F.coalesce(F.ceil(F.col("count") / PART), F.lit(1)).cast("int")
    cut = cut.withColumn("g", g).withColumn("part", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")
    cut = cut.select("bucket", "node", "lanes", "n_shingles", "side", "part", other)
    return cut.select("bucket", "node", "lanes", "n_shingles", "side", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))


def links(rows: DataFrame, radius: int, lanes: int, ratio: float = 0.0) -> DataFrame:
    """a, b: a spanning forest of the links within each task of ``rows`` (bucket, node, lanes, n_shingles, side)."""
    dealt = _parts(rows).repartition(partitions(rows.sparkSession), "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    dealt = dealt.select("bucket", "low", "high", "node", "side", "part", "n_shingles", *[F.col("lanes")[k].alias(f"l{k}") for k in range(lanes)])

    def of_task(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """t: rows by columns node, side, part, size, lanes; all of one task."""
        low = t[:, 2] == t[:, 2].min()
        prints = t[:, 4:].view(np.uint64)
        sizes = t[:, 3] if ratio else None
        whole = low.all()
        roots = np.arange(len(t))
        if whole:
            roots = tile_links(prints, t[:, 1], False, radius, sizes, ratio)
        elif not t[:, 1].any():
            roots = tile_links(prints, (~low).astype(np.int64), True, radius, sizes, ratio)
        else:  # two parts of two steps: own against own, own against the step below, both ways across the parts
            for a, b in ((0, 0), (0, 1), (1, 0)):
                pick = np.flatnonzero(low & (t[:, 1] == a) | ~low & (t[:, 1] == b))
                if len(pick):
                    found = tile_links(prints[pick], (~low[pick]).astype(np.int64), True, radius, None if sizes is None else sizes[pick], ratio)
                    roots = _unite(_roots(roots), pick, pick[found])
        far = np.flatnonzero(roots != np.arange(len(t)))
        return t[far, 0], t[roots[far], 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def table() -> Iterator[pa.RecordBatch]:
            block = np.concatenate(held)
            held.clear()
            cuts = np.flatnonzero((block[1:, :3] != block[:-1, :3]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), len(block)]
            found = [of_task(block[a:b, 3:]) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(HUBS)], names=["a", "b"])

        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]) if batch.num_rows else None
            if block is None:
                continue
            # All tasks but the last that the batch touches are whole.
            cuts = np.flatnonzero((block[1:, :3] != block[:-1, :3]).any(axis=1)) + 1
            if held and (held[-1][-1, :3] != block[0, :3]).any():
                yield from table()
            if len(cuts):
                held.append(block[: cuts[-1]])
                yield from table()
                block = block[cuts[-1] :]
            held.append(np.ascontiguousarray(block))
        if held:
            yield from table()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_components(prints: DataFrame, id_column: str, radius: int, lanes: int = 1, ratio: float = 0.0) -> DataFrame:
    """id_column, lanes, component_id of each row of ``prints`` (a written table of ``fingerprints``).

    Equal fingerprints (with ``ratio``: of equal size, too) are one node, named by its smallest id; the component of a
    node is the smallest id that links reach. Rows with a null id get a null component and link nothing.
    """
    same = ["lanes", "n_shingles"] if ratio else ["lanes"]
    nodes = prints.where(F.col(id_column).isNotNull()).groupBy(*same).agg(F.min(F.col(id_column).cast("long")).alias("node"), F.count("*").alias("copies"), *([] if ratio else [F.max("n_shingles").alias("n_shingles")]))
    nodes = written(nodes, "nodes")
    dealt = size_buckets(nodes, ratio) if ratio else band_buckets(nodes, radius)
    found = components(links(dealt, radius, lanes, ratio))
    code = F.xxhash64(*same).alias("code")
    named = nodes.join(found, "node", "left").select(code, *[F.col(c).alias(f"__{c}") for c in same], F.coalesce("component", "node").alias("component_id"))
    # Rows find their node by the hash of their fingerprint, a common fingerprint's dealt to many tasks, and compare it.
    hot = hot_keys(nodes.groupBy(code).agg(F.sum("copies").alias("n")).withColumnRenamed("code", "key"))
    known = prints.where(F.col(id_column).isNotNull()).select(id_column, *same, code)
    meets = F.lit(True)
    for c in same:
        meets = meets & (F.col(c) == F.col(f"__{c}"))
    out = spread_join(known, named, "code", hot).where(meets).select(id_column, "lanes", "component_id")
    return out.unionByName(prints.where(F.col(id_column).isNull()).select(id_column, "lanes", F.lit(None).cast("long").alias("component_id")))


def hexadecimal(lane: Column) -> Column:
    return F.lower(F.lpad(F.hex(lane), 16, "0"))


def simhash_components(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """id_column, fingerprint (16 hex digits), component_id (smallest id that links of at most ``radius`` bits reach).

    Null and wordless texts have fingerprint 0 and link like any other; repeated rows share a component; rows with a
    null id get a null component. An empty table gives an empty result. Other columns are not read.
    """
    prints = written(fingerprints(df, id_column, text_column, words), "prints")
    found = near_components(prints, id_column, radius)
    return found.select(id_column, hexadecimal(F.col("lanes")[0]).alias("fingerprint"), "component_id")


def prefix_length(n: int, similarity: float) -> int:
    """So many of n elements, first in an order that all sets share, that two sets of at least this Jaccard similarity have one of them in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def filter_places(key: str, size: int) -> list[Column]:
    """The two bits of a node in a filter of so many words."""
    return [F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(k)), F.lit(64 * size)) for k in range(2)]


def shingle_sets(df: DataFrame, id_column: str, text_column: str, words: int, wanted: np.ndarray | None = None) -> DataFrame:
    """id_column, key (128-bit hash of the set), n (its size), shingles (the distinct shingle hashes in order) of each whole text; a null text has none.

    wanted: a filter of ``wanted_words``; only rows whose id it holds, and a few others, are made.
    """
    kind = dict(df.dtypes)[id_column]
    shared = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)

    def work(columns: list[list]) -> Iterator[list]:
        if shared is not None:
            bits = [shared.value[at >> 6] >> (at & 63) & 1 for at in (np.array(c, np.int64) for c in columns[2:])]
            held = np.flatnonzero(bits[0] & bits[1]).tolist() if len(columns[0]) else []
            columns = [[c[k] for k in held] for c in columns[:2]]
        sets = [np.unique(shingle_hashes(text, words)).view(np.int64) for text in columns[1]]
        ends = np.cumsum([0, *map(len, sets)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
        yield [columns[0], [xxhash.xxh3_128_digest(h.tobytes()) for h in sets], [len(h) for h in sets], lists]

    places = [] if wanted is None else [c.alias(f"__place{k}") for k, c in enumerate(filter_places(id_column, len(wanted)))]
    source = df.select(F.col(id_column), text_or_empty(text_column).alias("__text"), *places)
    return map_batches(source, source.columns, work, f"`{id_column}` {kind}, key binary, n bigint, shingles array<bigint>")


def common_shingles(df: DataFrame, id_column: str, text_column: str, words: int) -> list[int]:
    """Shingles that at least ``COMMON`` documents of a sample of some ``SAMPLE`` hold, at most ``MOST_COMMON`` of them.

    They only go to the end of the order of shingles. Any order finds the same pairs; this one makes fewer candidates.
    """
    step = max(1, df.count() // SAMPLE)
    sample = df.where(F.pmod(F.xxhash64(id_column), F.lit(step)) == 0)
    tokens = shingle_sets(sample, id_column, text_column, words).select(F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").count().where(F.col("count") >= COMMON)
    return [r.token for r in counts.orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()]


def parity(h: np.ndarray) -> list[int]:
    """Words of 64 bits, each bit telling whether an odd number of the set's hashes fall on it: ``SKETCH`` words, doubled until there is a bit for each element.

    Two sets' sketches differ in no more bits than the sets in elements, as every element on one side alone flips one bit.
    The longer of two is folded to the shorter by exclusive-or of its halves, which is what the shorter length would have given.
    """
    size = SKETCH
    while 64 * size < len(h):
        size *= 2
    bits = np.bincount((h.view(np.uint64) % np.uint64(64 * size)).astype(np.int64), minlength=64 * size).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def prefixes(df: DataFrame, id_column: str, text_column: str, words: int, similarity: float) -> DataFrame:
    """id_column, key and n of ``shingle_sets``, tokens: the shingles of each set's prefix, rare ones first; sketch: ``parity`` of the set; lanes: its SimHash fingerprint."""
    kind = dict(df.dtypes)[id_column]
    late = df.sparkSession.sparkContext.broadcast(np.sort(np.array(common_shingles(df, id_column, text_column, words), dtype=np.int64)))

    def work(columns: list[list]) -> Iterator[list]:
        common, keys, sizes, out, sketches, prints = late.value, [], [], [], [], []
        for text in columns[1]:
            h = np.unique(shingle_hashes(text, words)).view(np.int64)
            sketches.append(parity(h))
            prints.append(np.array([majority(h)], np.uint64).view(np.int64).tolist())
            keys.append(xxhash.xxh3_128_digest(h.tobytes()))
            sizes.append(len(h))
            if len(common) and len(h):
                rare = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h
                h = np.concatenate([h[rare], h[~rare]])
            out.append(h[: prefix_length(len(h), similarity)])
        yield [columns[0], keys, sizes, out, sketches, prints]

    source = df.select(F.col(id_column), text_or_empty(text_column).alias("__text"))
    return map_batches(source, [id_column, "__text"], work, f"`{id_column}` {kind}, key binary, n bigint, tokens array<bigint>, sketch array<bigint>, lanes array<bigint>")


def joined_ends(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """``pairs`` (a, b: a written table) with the columns of ``ends`` (node, ...) for both, as a_... and b_...; the pairs of a hub are dealt to many tasks."""
    out = pairs
    for side in ("a", "b"):
        hot = hot_keys(pairs.groupBy(F.col(side).alias("key")).agg(F.count("*").alias("n")))
        out = spread_join(out, ends.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ends.columns if c != "node"]), side, hot)
    return out


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs with sets that are that similar."""
    both = joined_ends(pairs, sets.select("node", "n", "shingles"))
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return both.where(shared / (F.col("a_n") + F.col("b_n") - shared) >= similarity).select("a", "b")


def may_be_similar(a: str, b: str, n_a: Column, n_b: Column, similarity: float) -> Column:
    """Whether two sketches differ in no more bits than sets of that similarity differ in elements; lengths further apart than twofold are let through."""
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda c: F.zip_with(F.slice(c, 1, (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), xor)
    one, two = F.col(a), F.col(b)
    short = F.least(F.size(one), F.size(two))
    fitted = lambda c: F.when(F.size(c) == 2 * short, half(c)).otherwise(c)
    differ = F.aggregate(F.zip_with(fitted(one), fitted(two), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return (F.greatest(F.size(one), F.size(two)) > 2 * short) | (differ <= (1 - similarity) / (1 + similarity) * (n_a + n_b) + 1e-6)


def wanted_words(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of the nodes, as words of 64 bits; two bits a node, and at most ``BLOOM`` words however many nodes there are."""
    n = nodes.count()
    size = min(BLOOM, 1 << max(6, (n * 16 // 64).bit_length()))
    place = F.explode(F.array(*filter_places("node", size))).alias("bit")
    words = nodes.select(place).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    table = np.zeros(size, np.int64)
    for r in words.collect():
        table[r.word] = r.bits
    return table


def heavy_tokens(own: DataFrame) -> DataFrame:
    """key, pieces: tokens with more than 1 / (8 P) of all rows of ``own`` (n, tokens), and into how many pieces their rows go.

    A token with such a share of all rows has it in some block of rows as well. So each task counts its blocks and hands on
    only their frequent tokens, fewer than 8 P a block; what blocks keep back of one token is less than a piece in all.
    """
    share = HOT * partitions(own.sparkSession)
    total = own.agg(F.sum(F.size("tokens"))).first()[0] or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n > max(1, size // share)
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep]), pa.array(n[keep])], names=["key", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size > 1 << 22:
                yield frequent()
                held, size = [], 0
        if size:
            yield frequent()

    piece = max(1, -(-total // share))
    counts = own.select("tokens").mapInArrow(work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > piece).select("key", (F.ceil(F.col("n") / piece) + 1).cast("int").alias("pieces"))


def token_groups(own: DataFrame, heavy: DataFrame, similarity: float) -> DataFrame:
    """token, node, n, at, other: the rows whose token several sets have in their prefixes (other null), and for each of them up to ``HUBS`` others to compare it with.

    own: node, n, tokens. One shuffle by token; the rows of a heavy token are dealt to its pieces, each with hubs of its
    own. Hubs are the rows first in an order of nodes, so a task holds them and nothing else of a group. A pair is kept
    that can reach the similarity by its places: of its common shingles one is first in the order, and all lie from there on.
    """
    pieces = F.broadcast(heavy.select(F.col("key").alias("__hot"), F.col("pieces").alias("__pieces")))
    rows = own.select("node", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("at", "token"))
    rows = rows.join(pieces, F.col("token") == F.col("__hot"), "left")
    piece = F.when(F.col("__pieces").isNull(), -1).otherwise(F.pmod(F.xxhash64("node", F.lit(7)), F.col("__pieces"))).cast("int")
    rows = rows.select("token", piece.alias("piece"), F.xxhash64("node").alias("place"), "node", "n", "at")
    dealt = rows.repartition(partitions(own.sparkSession), "token", "piece").sortWithinPartitions("token", "piece", "place", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = np.zeros((0, 5), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.column_stack([batch.column(k).to_numpy().astype(np.int64) for k in (0, 1, 3, 4, 5)])
            old = len(carried)
            block = np.concatenate([carried, block])
            first = np.ones(len(block), bool)
            first[1:] = (block[1:, :2] != block[:-1, :2]).any(axis=1)
            start = np.flatnonzero(first)[np.cumsum(first) - 1]
            inside = np.arange(len(block)) - start
            fresh = np.arange(len(block)) >= old
            out = [np.column_stack([block[:, [0, 2, 3, 4]], np.full(len(block), NONE)])[(fresh & ((inside > 0) | (block[:, 1] >= 0)))]]
            # The first row of a group counts once a second one is there.
            lone = np.flatnonzero(fresh & (inside == 1) & (block[:, 1] < 0)) - 1
            out.append(np.column_stack([block[lone][:, [0, 2, 3, 4]], np.full(len(lone), NONE)]))
            for k in range(HUBS):
                i = np.flatnonzero(fresh & (inside > k))
                j = start[i] + k
                most = np.minimum(block[i, 3] - block[i, 4], block[j, 3] - block[j, 4])
                keep = (most >= similarity / (1 + similarity) * (block[i, 3] + block[j, 3]) - 1e-6) & (block[i, 2] != block[j, 2])
                i, j = i[keep], j[keep]
                pairs = np.unique(np.column_stack([np.minimum(block[i, 2], block[j, 2]), np.maximum(block[i, 2], block[j, 2])]), axis=0) if len(i) else np.zeros((0, 2), np.int64)
                zero = np.zeros(len(pairs), np.int64)
                out.append(np.column_stack([zero, pairs[:, 0], zero, zero, pairs[:, 1]]))
            table = np.concatenate(out)
            other = pa.array(table[:, 4], mask=table[:, 4] == NONE)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1]), pa.array(table[:, 2].astype(np.int32)), pa.array(table[:, 3].astype(np.int32)), other], names=["token", "node", "n", "at", "other"])
            last = start[-1]
            carried = block[last : last + HUBS]

    return dealt.mapInArrow(run, "token bigint, node bigint, n int, at int, other bigint")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """id_column, component_id: SimHash near-duplicates, held to the exact Jaccard similarity of the sets of five-word shingles of whole documents.

    Two documents link if it is at least ``similarity``; the component is the smallest id that links reach. Equal sets
    (so all wordless texts) are one node. First come the components of the sets' SimHash fingerprints (``near_components``, links of at most ``radius`` bits):
    each set is compared with the smallest id of its own. No radius gives the similarity exactly, so sets with a shingle of their prefixes in common, which
    loses no pair, are candidates as well. The first round also compares each set with ``HUBS`` of those that share a shingle, so a large group of near copies is
    joined by rows in proportion to it. The second compares the candidates that are in different components by then: in
    each group of a shingle the rows outside its largest component with all others of another component and of a size
    that allows the similarity. In both rounds a candidate is dropped whose parity sketches differ in more bits than sets of that similarity differ in elements.
    Rows with a null id get a null component and link nothing. Rows of one id with different texts are one node with several sets.
    """
    spark = df.sparkSession
    known = df.where(F.col(id_column).isNotNull())
    rows, rows_path = written_at(prefixes(known, id_column, text_column, words, similarity).withColumn("node", F.col(id_column).cast("long")), "prefixes")
    nodes = written(rows.groupBy("key").agg(F.min("node").alias("node"), F.count("*").alias("copies")), "nodes")
    own = rows.join(nodes, ["node", "key"], "left_semi").dropDuplicates(["node", "key"])
    own, own_path = written_at(own.select("node", "key", "n", "tokens", "sketch", "lanes"), "own")
    keys = written(rows.select(id_column, "key"), "keys")
    delete_path(spark, rows_path)
    sketches = own.select("node", "key", F.col("n").alias("size"), "sketch")
    heavy = written(heavy_tokens(own), "heavy")
    groups = written(token_groups(own, heavy, similarity), "groups")
    hashed = near_components(own.select("node", "lanes", F.col("n").alias("n_shingles")), "node", radius).where(F.col("node") != F.col("component_id"))
    starred = groups.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(hashed.select(F.col("component_id").alias("a"), F.col("node").alias("b"))).distinct()
    met = groups.where("other is null").select("token", "node", "n", "at")
    first = joined_ends(written(starred, "star"), sketches.drop("key")).where(may_be_similar("a_sketch", "b_sketch", F.col("a_size"), F.col("b_size"), similarity))
    first = written(first.select("a", "b").distinct(), "pairs")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets of the nodes in pairs, made from their texts again: most documents are in none."""
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
        wanted = ends.join(sketches.select("node", "key"), "node")
        found = shingle_sets(known, id_column, text_column, words, wanted_words(ends)).withColumn("node", F.col(id_column).cast("long"))
        return found.join(wanted, ["node", "key"], "left_semi").dropDuplicates(["node", "key"])

    def linked(pairs: DataFrame) -> DataFrame:
        sets, path = written_at(sets_of(pairs), "sets")
        found = written(similar_pairs(pairs, sets, similarity), "links")
        delete_path(spark, path)
        return found

    links_ = linked(first)
    pieces = components(links_)
    named = written(met.join(pieces, "node", "left").select("token", "node", "n", "at", F.coalesce("component", "node").alias("piece")), "named")
    # Shingles that many documents share are dealt to many tasks in every join on them.
    shares = named.groupBy("token", "piece").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("pieces"), F.max_by("piece", "n").alias("largest"))
    mixed = spread_join(named, shares.where("pieces > 1").select("token", "largest"), "token", heavy).join(sketches.drop("key"), "node")
    mixed = written(mixed, "mixed")
    # Two sets of the similarity have sizes at most a step of this scale apart.
    step = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / -math.log(similarity) + 1e-9)
    key = lambda size: F.xxhash64("token", size)
    left = mixed.where("piece <> largest").withColumn("key", key(step)).select("key", "node", "n", "at", "piece", "largest", "sketch", "size")
    other = mixed.withColumn("key", F.explode(F.array(*[key(step + k) for k in (-1, 0, 1)])))
    other = other.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "piece", "sketch", "size")])
    crowded = hot_keys(left.groupBy("key").agg(F.count("*").alias("n")))
    fit = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= similarity / (1 + similarity) * (F.col("n") + F.col("n_b")) - 1e-6
    # Of two rows outside the largest component each finds the other: one time counts.
    once = (F.col("piece_b") == F.col("largest")) | (F.col("node") < F.col("node_b"))
    rest = spread_join(left, other, "key", written(crowded, "crowded")).where((F.col("piece") != F.col("piece_b")) & once & fit & may_be_similar("sketch", "sketch_b", F.col("size"), F.col("size_b"), similarity))
    second = written(rest.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    found = components(links_.unionByName(linked(second)))
    delete_path(spark, own_path)
    code = F.xxhash64("key").alias("code")
    labels = nodes.join(found, "node", "left").select(code, F.col("key").alias("__key"), F.coalesce("component", "node").alias("component_id"))
    hot = hot_keys(nodes.groupBy(code).agg(F.sum("copies").alias("n")).withColumnRenamed("code", "key"))
    out = spread_join(keys.select(id_column, "key", code), labels, "code", hot).where("key = __key").select(id_column, "component_id")
    return out.unionByName(df.where(F.col(id_column).isNull()).select(id_column, F.lit(None).cast("long").alias("component_id")))
