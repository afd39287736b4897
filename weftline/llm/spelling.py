"""Spelling variants: words one edit apart, found by keys of their deletions.

Every word of n characters has n patterns with one character left open, and up to n words with one character less. The
hashes of all of them come from two running polynomial hashes, of its beginnings and of its ends, in a few numpy
operations for all words of a length. Keys are dealt to partitions by their top bits and sorted there; what stands
under one key is compared as strings, so that a hash shared by chance joins nothing.

No pair is ever written out. Two words that differ in one character share exactly one open pattern, and a word that is
another one without one character shares exactly one key with it. So each member of a group gets the number of the others
and the best of them, and sums over the keys are exact. A group holds at most as many words as the alphabet has
characters (or that times a word's length, for the words one character longer): a bound that no data moves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import delete_path, map_batches, partitions, text_or_empty, written, written_at

RUNS = re.compile("[a-zÀ-ÿ]+")
#: Of so many (document, run) one is misspelt on purpose.
SLIP = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: Distinct words that a task holds before it hands on their counts.
HELD = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
FULL = -1


def slipped(prefix: int, run: str) -> str:
    """The run, or one code point less where the checksum of ``<doc_id>:<run>`` says so; ``prefix`` is the checksum of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: letter runs of all whole texts (A-Z lower-cased, slips applied), those of the least length and count.

    A null text has none; a null id is the empty string in the checksum. Repeated rows count again. Counts are summed in
    each task first, then by Spark; the alphabet, not the documents, bounds what a task holds.
    """

    def work(columns: list[list]) -> Iterator[list]:
        held: Counter = Counter()
        for key, text in zip(*columns, strict=True):
            prefix = zlib.crc32(b"%s:" % (b"" if key is None else str(key).encode()))
            for run, n in Counter(RUNS.findall(text.encode().lower().decode())).items():
                word = slipped(prefix, run)
                if len(word) >= least_length:
                    held[word] += n
            if len(held) > HELD:
                yield [list(held), list(held.values())]
                held.clear()
        yield [list(held), list(held.values())]

    source = df.select(F.col(id_column).alias("__id"), text_or_empty(text_column).alias("__text"))
    found = map_batches(source, ["__id", "__text"], work, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length: keys (uint64), the word's number, and the kind of each key.

    Kind ``FULL``: the word itself. Kinds 0 to n - 1: the word with that character open, equal only for words of this
    length. Kinds n and on: the word without character (kind - n), once for a stretch of equal characters, equal to the
    ``FULL`` key of the word that is left.
    """
    size, rows = len(words[0]), len(words)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(rows, size).astype(np.uint64) + np.uint64(1)
    power = np.concatenate([np.ones(1, np.uint64), np.full(size, BASE)]).cumprod(dtype=np.uint64)
    front, back = np.zeros((rows, size + 1), np.uint64), np.zeros((rows, size + 1), np.uint64)
    for i in range(size):
        front[:, i + 1] = front[:, i] * BASE + codes[:, i]
        j = size - 1 - i
        back[:, j] = codes[:, j] * power[i] + back[:, j + 1]
    without = front[:, :-1] * power[size - 1 - np.arange(size)][None, :] + back[:, 1:]
    place = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    open_ = mixed(without ^ mixed(place)[None, :])
    first = np.ones((rows, size), bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    number = np.arange(rows)
    w, at = np.nonzero(first)
    keys = np.concatenate([mixed(front[:, -1]), open_.ravel(), mixed(without)[first]])
    return keys, np.concatenate([number, np.repeat(number, size), w]), np.concatenate([np.full(rows, FULL), np.tile(np.arange(size), rows), at + size])


def residue(word: str, kind: int) -> tuple[int, str]:
    """What must be equal for two rows of a key to belong together: the open place (or -1) and the characters left."""
    if kind == FULL:
        return FULL, word
    at = kind % len(word)
    return (at if kind < len(word) else FULL), word[:at] + word[at + 1 :]


def group_results(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """word, near words, count and string of the best of them, from the rows (word, n, kind) of one key."""
    groups: dict[tuple[int, str], list[tuple[int, str, int]]] = {}
    for word, n, kind in rows:
        groups.setdefault(residue(word, kind), []).append((-n, word, kind))
    for (place, left), members in groups.items():
        if len(members) < 2:
            continue
        members.sort()
        if place != FULL:
            for k, (_, word, _) in enumerate(members):
                n, best, _ = members[1 if k == 0 else 0]
                yield word, len(members) - 1, -n, best
        elif whole := next((m for m in members if m[2] == FULL), None):
            longer = [m for m in members if m[2] != FULL]
            yield left, len(longer), -longer[0][0], longer[0][1]
            for _, word, _ in longer:
                yield word, 1, -whole[0], left


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of a table of distinct words (word, n)."""

    def keyed(columns: list[list]) -> Iterator[list]:
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(columns[0]):
            by_length.setdefault(len(word), []).append(i)
        names, counts = columns
        for size, chosen in by_length.items():
            # About so many keys at a time, whatever the words' length.
            step = max(1, (1 << 18) // max(size, 1))
            for a in range(0, len(chosen) if size else 0, step):
                part = chosen[a : a + step]
                keys, number, kind = deletion_keys([names[i] for i in part])
                picked = pa.array(number)
                yield [keys.view(np.int64), pa.array([names[i] for i in part]).take(picked), pa.array([counts[i] for i in part], pa.int64()).take(picked), kind]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int]] = []
        held_key = None
        schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

        def batch_of(found: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            inside = np.concatenate([[False], same]) | np.concatenate([same, [True]])
            inside[0] |= held_key is not None and keys[0] == held_key
            inside[-1] = True
            # Only keys with several rows are looked at, and the last one, which may go on in the next batch.
            picked = np.flatnonzero(inside)
            part = batch.take(pa.array(picked))
            out: list[tuple[str, int, int, str]] = []
            for key, word, n, kind in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != held_key:
                    if len(held) > 1:
                        out.extend(group_results(held))
                    held, held_key = [], key
                held.append((word, n, kind))
            if out:
                yield batch_of(out)
        if len(held) > 1 and (out := list(group_results(held))):
            yield batch_of(out)

    parts = partitions(words.sparkSession)
    keys = map_batches(words, ["word", "n"], keyed, "key bigint, word string, n bigint, kind int")
    radix = F.shiftrightunsigned("key", 33).cast("int") % F.lit(parts)
    found = keys.repartitionById(parts, radix).sortWithinPartitions("key").mapInArrow(results, "word string, n_near bigint, best_n bigint, best string")
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:bigint,best:string>").alias("at"))
    met = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("less"), "best").alias("at"))
    summed = own.unionByName(met).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("at").alias("at"))
    is_form = -F.col("at.less") >= RATIO * F.col("n")
    return summed.select("word", "n", "n_near", F.when(is_form, F.col("at.best")).alias("form"), F.when(is_form, -F.col("at.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms ends, of a table (word, form) without null forms.

    Every form is five times as frequent as its word, so no chain has more than 27 steps in 64-bit counts, and five rounds that
    double the reach are enough; it ends when no root moves.
    """
    at, path = written_at(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step, step_path = written_at(at.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        delete_path(forms.sparkSession, path)
        at, path = step.select("word", "root"), step_path
        if step.where("moved").isEmpty():
            return at


def spelling_variants(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, form, root string; n, n_near, form_n long: one row for each word of ``word_counts``.

    form: the most frequent word one edit away (ties: first in code-point order) if it is at least five times as
    frequent; root: where the chain of forms ends. Words without a near word have 0, null, themselves, null. Other columns
    aren't read; an empty table gives an empty result.
    """
    words = written(word_counts(df, id_column, text_column), "words")
    found = written(near_words(words), "near")
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
