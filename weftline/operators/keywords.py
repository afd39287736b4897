"""Keyword lists over texts by an automaton: one pass over each text finds all words of the list, however long it is.

The list is a table that people write; it is numbered in its order, sent to the tasks in parts of ``WORDS`` words, and
each part is one automaton (Aho-Corasick). A text is read once for each part, and what comes back is the numbers of the words that it holds.
Where the words are only ways to a result (the first word, the labels), rows of the list that can't change it are left out by Spark
before: a word that the list repeats would be found as often in every text that holds it.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType

from weftline.functions.text import blank

#: Words of one automaton: about 200 bytes each in a worker.
WORDS = 200_000
#: Words up to this length must be a whole field or a token of it.
SHORT = 3
PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

_AUTOMATA: dict[int, ahocorasick.Automaton] = {}


def _automaton(shared) -> ahocorasick.Automaton:
    """One for each worker process and list, kept over its tasks: each word leads to its length and the numbers that it has in the list."""
    key = id(shared.value)
    if key not in _AUTOMATA:
        if len(_AUTOMATA) > 4:
            _AUTOMATA.clear()
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for number, word in enumerate(shared.value):
            found.add_word(word, (len(word), [*found.get(word, (0, []))[1], number]))
        found.make_automaton()
        _AUTOMATA[key] = found
    return _AUTOMATA[key]


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether a short word is the whole text, or one of its runs of ASCII letters and digits."""
    if start == 0 and end == len(text):
        return True
    return PLAIN.issuperset(text[start:end]) and not (start and text[start - 1] in PLAIN) and not (end < len(text) and text[end] in PLAIN)


def _held(shared, tokens: bool, say=list, kind: DataType = IntegerType()):
    """A column function: the numbers of the words that a lower-case text holds, ascending, as ``say`` gives them."""

    def held(texts: pd.Series) -> pd.Series:
        automaton, out = _automaton(shared), []
        for text in texts:
            numbers: set[int] = set()
            for last, (size, found) in automaton.iter(text):
                if not tokens or size > SHORT or stands_alone(text, last + 1 - size, last + 1):
                    numbers.update(found)
            out.append(say(sorted(numbers)))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(held, ArrayType(kind))


def hits(df: DataFrame, text: Column, words: DataFrame, order: list[str], tokens: bool = False, first: bool = False) -> DataFrame:
    """The rows of ``df`` with the columns of each word (word, ...) that ``text`` holds, whatever its case; with ``first`` only the word first by ``order``.

    Blank words match nothing. With ``tokens`` words of up to ``SHORT`` letters must be the whole text or a token between what is no ASCII letter or digit (J20).
    """
    spark, names = df.sparkSession, words.columns
    known = words.where(F.col("word") != "").withColumn("__low", F.lower("word"))
    if first:  # of one word's rows only the first can win
        rest = [c for c in names if c not in order]
        known = known.groupBy("__low").agg(F.min(F.struct(*order, *rest)).alias("__w")).select(*[F.col("__w")[c].alias(c) for c in names], "__low")
    listed = known.orderBy(*order).collect()
    if not listed:
        return df.crossJoin(words.limit(0))
    parts = []
    for at in range(0, len(listed), WORDS):
        rows = listed[at : at + WORDS]
        shared = spark.sparkContext.broadcast([r["__low"] for r in rows])
        numbers = _held(shared, tokens, (lambda n: n[:1]) if first else list)(F.lower(blank(text)))
        found = df.withColumn("__word", F.explode(numbers))
        table = spark.createDataFrame([(k, *r[:-1]) for k, r in enumerate(rows)], "__word int, " + ", ".join(f"`{n}` {t}" for n, t in words.dtypes))
        parts.append(found.join(F.broadcast(table), "__word").withColumn("__word", F.col("__word") + at))
    out = reduce(DataFrame.unionByName, parts)
    if first and len(parts) > 1:
        own = [F.col(c) for c in df.columns]
        out = out.groupBy(*own).agg(F.min(F.struct("__word", *names)).alias("__w")).select(*own, *[F.col("__w")[n].alias(n) for n in names])
    return out.drop("__word")


def labels(df: DataFrame, key: str, text: Column, words: DataFrame, seq: str = "seq") -> DataFrame:
    """``key`` and labels, the labels of all words (word, label, ``seq``) that ``text`` holds, whatever its case: each once, by its least ``seq``, then by itself. Rows are unique by ``key``.

    A word and label count once in the list, and a text hands on each of its labels once, so nothing grows with their repeats.
    """
    spark = df.sparkSession
    known = words.where(F.col("word") != "").groupBy(F.lower("word").alias("low"), F.col("label").cast("string").alias("label")).agg(F.min(seq).alias("seq"))
    listed = known.orderBy("seq", "label").collect()
    parts = []
    for at in range(0, len(listed), WORDS):
        rows = listed[at : at + WORDS]
        shared = spark.sparkContext.broadcast([r.low for r in rows])
        named = spark.sparkContext.broadcast([r.label for r in rows])

        def say(numbers: list[int], named=named, at=at) -> list[str]:
            """Labels behind the ten digits of their place in the list."""
            first: dict[str | None, int] = {}
            for n in numbers:
                first.setdefault(named.value[n], n)
            return [f"{at + n:010}" if label is None else f"{at + n:010}:{label}" for label, n in first.items()]

        parts.append(df.select(key, _held(shared, False, say, StringType())(F.lower(blank(text))).alias("found")))
    if not parts:
        return df.select(key, F.array().cast("array<string>").alias("labels"))
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        found = found.groupBy(key).agg(F.flatten(F.collect_list("found")).alias("found"))
    label = lambda x: F.when(F.length(x) > 10, F.substring(x, 12, 1 << 30))
    return found.select(key, F.array_distinct(F.transform(F.array_sort("found"), label)).alias("labels"))
