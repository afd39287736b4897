"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 characters of words with a mark at both ends) in
order of frequency. A document's own list is compared with each profile by the out-of-place distance: the sum of the
differences of rank, and the length of the profile for an n-gram that it lacks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import held, map_batches

#: Words are runs of letters (category L); number characters such as a half or a Roman numeral are none. Vowel signs and other
#: marks part words, so scripts that write with them (Devanagari, Thai) are compared by the letters between.
WORDS = regex.compile(r"\p{L}+")
GRAMS = 400
#: Languages that a broadcast table of profiles may have.
MOST_LANGS = 2000
MARK = ord("_")
CHUNK = 1 << 18
FLUSH = 100_000


def grams_of(word: str) -> list[str]:
    """The n-grams of one word, the mark alone left out."""
    marked = f"_{word}_"
    return [g for n in (1, 2, 3) for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) != "_"]


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of all words of a text. A key is the code points in 21 bits each, so keys sort like the n-grams."""
    words = WORDS.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # One mark between two words ends the one and begins the other; n-grams with a mark inside belong to neither.
    codes = np.frombuffer(f"_{'_'.join(words)}_".encode("utf-32-le", "surrogatepass"), "<u4")
    chars = np.flatnonzero(np.bincount(codes))
    place = np.zeros(chars[-1] + 1, np.int64)
    place[chars] = np.arange(len(chars))
    c, k, mark = place[codes], len(chars), int(place[MARK])
    a, b, d = c[:-2], c[1:-1], c[2:]
    inside = b != mark
    found, wide = [], chars.astype(np.uint64)
    for size, value in ((k, c[c != mark]), (k * k, c[:-1] * k + c[1:]), (k**3, (a * k * k + b * k + d)[inside])):
        if size <= 4 * len(value) + 100_000:
            counts = np.bincount(value)
            seen = np.flatnonzero(counts)
            counts = counts[seen]
        else:
            seen, counts = np.unique(value, return_counts=True)
        if not found:
            keys = wide[seen] << np.uint64(42)
        elif len(found) == 1:
            keys = wide[seen // k] << np.uint64(42) | wide[seen % k] << np.uint64(21)
        else:
            keys = wide[seen // (k * k)] << np.uint64(42) | wide[seen // k % k] << np.uint64(21) | wide[seen % k]
        found.append((keys, counts))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def gram_of(key: int) -> str:
    return "".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)


def key_of(gram: str) -> int:
    key = 0
    for c in gram.ljust(3, "\0"):
        key = key << 21 | ord(c)
    return key


def held_out(id_column: str = "doc_id") -> Column:
    """True where crc32(id as text) mod 3 is 1; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_profiles(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", grams: int = GRAMS) -> DataFrame:
    """The profile of each language over all rows: lang, gram, rank (from 0), by count and then by gram.

    Each task counts the n-grams of a language's texts, about a quarter of a megabyte at once, and hands on sums; a table that reaches
    ``FLUSH`` entries is handed on early, so memory is bounded and one common language makes no large task.
    """

    def work(columns: list[list]) -> Iterator[list]:
        waiting: dict[str, list[str]] = {}
        size: Counter = Counter()
        sums: Counter = Counter()

        def count(lang: str) -> None:
            keys, counts = count_grams("\n".join(waiting.pop(lang)))
            size[lang] = 0
            for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
                sums[lang, key] += n

        def handed_on() -> list:
            out = [[k[0] for k in sums], [gram_of(k[1]) for k in sums], list(sums.values())]
            sums.clear()
            return out

        for text, lang in zip(*columns, strict=True):
            waiting.setdefault(lang, []).append(text)
            size[lang] += len(text)
            if size[lang] > CHUNK:
                count(lang)
                if len(sums) > FLUSH:
                    yield handed_on()
        for lang in list(waiting):
            count(lang)
            if len(sums) > FLUSH:
                yield handed_on()
        yield handed_on()

    source = labelled.select(F.col(text_column).cast("string").alias("__text"), F.col(lang_column).cast("string").alias("__lang")).where("__text is not null and __lang is not null")
    counted = map_batches(source, ["__text", "__lang"], work, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Compared as a row number, so that each task hands on no more than ``grams`` rows of a language.
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= grams).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class Profiles:
    """Profiles as rank arrays."""

    def __init__(self, rows: list[tuple[str, str, int]], grams: int) -> None:
        self.langs, self.grams = sorted({r[0] for r in rows}), grams
        self.keys = np.array(sorted({key_of(r[1]) for r in rows}), np.uint64)
        self.ranks = np.full((len(self.langs), len(self.keys)), -1, dtype=np.int64)
        for lang, gram, rank in rows:
            self.ranks[self.langs.index(lang), np.searchsorted(self.keys, np.uint64(key_of(gram)))] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = count_grams(text) if text else ((), ())
        if not len(keys) or not self.langs:
            return "und", 0.0
        if len(keys) > self.grams:
            least = -np.partition(-counts, self.grams - 1)[self.grams - 1]
            keys, counts = keys[counts >= least], counts[counts >= least]
        own = keys[np.lexsort((keys, -counts))][: self.grams]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == own)
        theirs = self.ranks[:, at[known]]
        apart = np.where(theirs >= 0, np.abs(theirs - known), self.grams).sum(axis=1) + self.grams * (len(own) - len(known))
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.grams * len(own)))


def predict_languages(df: DataFrame, profiles: DataFrame, id_column: str = "doc_id", text_column: str = "text", grams: int = GRAMS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predicts the language of every whole text: id_column, lang_pred, score, then the columns in ``keep``.

    score is 1 less the distance over the largest possible one. A null text, one without a letter (digits, fractions and
    numerals are none), and any text when
    there are no profiles gets ``und`` and 0. Ties go to the language that is first in the alphabet. The profiles (at
    most ``grams`` rows a language) are collected and broadcast; rows are not shuffled.
    """
    rows = [(r.lang, r.gram, r.rank) for r in profiles.limit(MOST_LANGS * grams + 1).collect()]
    if len(rows) > MOST_LANGS * grams:
        raise ValueError(f"more than {MOST_LANGS} languages")
    shared = df.sparkSession.sparkContext.broadcast(rows)
    kinds = dict(df.dtypes)

    def work(columns: list[list]) -> Iterator[list]:
        known = held(shared, lambda value: Profiles(value, grams))
        found = [known.predict(t) for t in columns[1]]
        yield [columns[0], [f[0] for f in found], [f[1] for f in found], *columns[2:]]

    source = df.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])
    schema = ", ".join([f"`{id_column}` {kinds[id_column]}", "lang_pred string", "score double", *[f"`{c}` {kinds[c]}" for c in keep]])
    return map_batches(source, source.columns, work, schema)
