"""Line deduplication by content-defined chunks of lines.

A text is cut into lines; a rolling hash over the hashes of the last ``WINDOW`` lines decides where a chunk ends, so
boundaries depend on nearby lines only and shift with them when lines are put in before. A chunk of two lines or more
that stood before (in a document with a smaller id, or earlier in the same one) is removed once its bytes have been
compared with those of the first one.

One chunking finds long repeats by few chunks, but a short one between other neighbours shares its first or last chunk with
them. So a text is cut at two levels: by the rolling hash with ``MASK``, and with every line as a boundary (a mask of zero),
where a chunk is two lines and the next begins a line later. Any repeated run of two lines or more is made of such chunks.

Chunks are first counted by hash alone; only chunks whose hash repeats travel with their bytes, and grouping by these
bytes is the comparison. All counts are pre-aggregated in each task, so a chunk of a third of all documents costs a row a
task there, and the two joins that lead from chunks back to their places deal the rows of such a chunk to many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import hot_keys, map_batches, spread_join, written

WINDOW = 2
MASK = 3  # a boundary after a line with a probability of 1 / (MASK + 1)
LEAST_LINES = 2


def chunks(text: str, window: int = WINDOW, mask: int = MASK) -> list[tuple[int, int]]:
    """First line and line behind the last of each chunk of ``text.split(chr(10))``; the last chunk ends with the text."""
    hashes = [xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) for line in text.split("\n")]
    out, first = [], 0
    for i in range(len(hashes)):
        rolling = 0
        for h in hashes[max(first, i - window + 1) : i + 1]:
            rolling = (rolling * 0x100000001B3 + h) & 0xFFFFFFFFFFFFFFFF
        if i + 1 - first >= LEAST_LINES and (rolling ^ rolling >> 29) & mask == 0:
            out.append((first, i + 1))
            first = i + 1
    if first < len(hashes):
        out.append((first, len(hashes)))
    return out


def line_runs(text: str) -> list[tuple[int, int]]:
    """First line and line behind the last of each shortest run of lines that can repeat; these overlap.

    Every two neighbouring lines of which one has a letter or digit are such a run, and so is a stretch of lines without
    any together with the lines around it. A longer repeated run consists of these, wherever it begins and ends, so all of it is found.
    """
    lines = text.split("\n")
    lettered = [i for i, line in enumerate(lines) if any(c.isalnum() for c in line)]
    out = {(i - 1, i + 1) for i in lettered if i} | {(i, i + 2) for i in lettered if i + 1 < len(lines)}
    if lettered:
        out |= {(a, b + 1) for a, b in zip([0, *lettered], [*lettered, len(lines) - 1], strict=True) if b > a}
    return sorted(out)


def chunkings(text: str) -> list[tuple[int, int]]:
    """The chunks of both levels, in order; they overlap."""
    return sorted({*chunks(text), *line_runs(text)})


def signed_hash(data: bytes) -> int:
    """What ``xxhash64`` of Spark gives for these bytes."""
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (h >> 63 << 64)


def _chunk_bytes(lines: list[str], a: int, b: int) -> bytes:
    return "\n".join(lines[a:b]).encode("utf-8", "surrogatepass")


def line_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), cut: Callable[[str], list[tuple[int, int]]] = chunkings) -> DataFrame:
    """Removes repeated multi-line chunks: id_column, text, n_lines, n_removed (lines), then the columns in ``keep``.

    ``cut`` gives the chunks of a text in order: ``chunkings`` for every repeated run of two lines or more, ``chunks`` for
    the rolling hash's own. Chunks may overlap; a line goes with any of them. The first chunk by (id, position) stays. Chunks without a letter or digit are never removed. A document is its id and
    text: repeated rows are treated alike and all keep what the first may keep. Null ids come first. A null text stays null (no lines).
    """
    kinds = dict(df.dtypes)
    doc = F.xxhash64(F.coalesce(F.col("__text"), F.lit("")))
    rows = df.select(F.col(id_column).cast("long").alias("__key"), F.col(text_column).cast("string").alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])
    rows = rows.select("__key", doc.alias("__doc"), "__text", *[f"__{i}" for i in range(len(keep))])
    place = F.struct(F.col("key"), F.col("doc"), F.col("first"))

    def hashed(columns: list[list]) -> Iterator[list]:
        out: tuple[list, ...] = ([], [], [], [])
        for key, doc_, text in zip(*columns, strict=True):
            if text is None or "\n" not in text:
                continue
            lines = text.split("\n")
            for k, (a, b) in enumerate(cut(text)):
                if b - a >= LEAST_LINES and any(c.isalnum() for line in lines[a:b] for c in line):
                    for column, value in zip(out, (key, doc_, k, signed_hash(_chunk_bytes(lines, a, b))), strict=True):
                        column.append(value)
        yield list(out)

    found = map_batches(rows.select("__key", "__doc", "__text"), ["__key", "__doc", "__text"], hashed, "key bigint, doc bigint, first int, hash bigint")
    # A hash repeats if it stands at two places; their least and greatest hashes need one short row a task and hash.
    at = F.xxhash64("key", "doc", "first")
    repeated = found.groupBy("hash").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n")).where("low < high").select("hash", "n")
    repeated = written(repeated, "repeated")
    hot = hot_keys(repeated.select(F.col("hash").alias("key"), "n"))
    where = spread_join(found, repeated.select("hash"), "hash", hot).groupBy("key", "doc").agg(F.array_sort(F.collect_set("first")).alias("firsts"))

    def with_bytes(columns: list[list]) -> Iterator[list]:
        out: tuple[list, ...] = ([], [], [], [])
        for key, doc_, text, firsts in zip(*columns, strict=True):
            lines, places, wanted = text.split("\n"), cut(text), set(firsts)
            for k in wanted:
                for column, value in zip(out, (key, doc_, k, _chunk_bytes(lines, *places[k])), strict=True):
                    column.append(value)
        yield list(out)

    dealt = rows.alias("r")
    meets = lambda other: F.col("__doc").eqNullSafe(F.col(f"{other}.doc")) & F.col("__key").eqNullSafe(F.col(f"{other}.key"))
    texts = dealt.join(where.alias("w"), meets("w")).select("__key", "__doc", "__text", "firsts")
    compared = map_batches(texts, ["__key", "__doc", "__text", "firsts"], with_bytes, "key bigint, doc bigint, first int, chunk binary")
    least = compared.groupBy("chunk").agg(F.min(place).alias("low"))
    # Hot chunks are told by their hash, whose counts are known; the join compares the bytes as well.
    compared, least = (d.withColumn("hash", F.xxhash64("chunk")) for d in (compared, least))
    found_again = spread_join(compared, least.withColumnRenamed("chunk", "same"), "hash", hot).where("chunk = same")
    gone = found_again.where(place > F.col("low")).groupBy("key", "doc").agg(F.collect_set("first").alias("gone"))

    def kept(columns: list[list]) -> Iterator[list]:
        keys, texts_, gones, *rest = columns
        new, n_lines, n_removed = [], [], []
        for text, gone_ in zip(texts_, gones, strict=True):
            lines = [] if text is None else text.split("\n")
            n_lines.append(len(lines))
            if gone_:
                places = cut(text)
                here: dict[str, int] = {}
                firsts = [here.setdefault("\n".join(lines[a:b]), k) for k, (a, b) in enumerate(places)]
                drop: set[int] = set()
                for k in set(gone_):
                    # Where runs overlap, the first place stays whole: of four equal lines two go.
                    stay = () if firsts[k] in gone_ else range(*places[firsts[k]])
                    drop.update(i for i in range(*places[k]) if i not in stay)
                lines = [line for i, line in enumerate(lines) if i not in drop]
                text = "\n".join(lines)
            new.append(text)
            n_removed.append(n_lines[-1] - len(lines))
        yield [keys, new, n_lines, n_removed, *rest]

    final = dealt.join(gone.alias("g"), meets("g"), "left").select("__key", "__text", "gone", *[f"__{i}" for i in range(len(keep))])
    schema = ", ".join([f"`{id_column}` bigint", "text string", "n_lines bigint", "n_removed bigint", *[f"`{c}` {kinds[c]}" for c in keep]])
    return map_batches(final, final.columns, kept, schema)
