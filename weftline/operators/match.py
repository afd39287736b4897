"""Record matching: equi-joins on normalised keys, blocked fuzzy joins, and the staged cascade over what is left.

A knowledge base is joined by key; Spark broadcasts it only where its measured size is under the session's threshold.
Every stage works on the rows that no stage before has matched (anti joins), so costly comparisons see few rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import keywords
from weftline.operators.ranking import best_scored
from weftline.operators.similarity import best_similar, confidence, dealt_join, similar_pairs
from weftline.session import written


def exact_merge(probe: DataFrame, kb: DataFrame, keys: list[str], suggestion: list[str]) -> DataFrame:
    """Probe keys (each once) with the suggestions of the equal record keys; blank keys match nothing.

    Returns key_hash, n and suggestions array<struct> in the order of their fields. Keys are joined and grouped by the
    hash of their normalised parts, so whole texts may be keys without being shuffled.
    """
    hashed = lambda side: text.key_hash(*[text.normalise(F.col(k)) for k in keys], side=side).alias("key_hash")
    left = probe.select(hashed("a")).distinct()
    right = kb.select(hashed("b"), F.struct(*suggestion).alias("s"))
    return left.join(right, "key_hash").groupBy("key_hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("s")).alias("suggestions"))


def lower_join(probe: DataFrame, kb: DataFrame, pairs: list[tuple[str, str]], counts: float = 1.0) -> DataFrame:
    """Rows whose columns are equal but for case (white space counts), nulls matching nothing; their confidence is ``counts``."""
    return _hash_join(probe, kb, pairs, F.lower, counts)


def deep_join(probe: DataFrame, kb: DataFrame, pairs: list[tuple[str, str]], counts: float = 0.95) -> DataFrame:
    """Rows whose deep-normalised columns are equal and none blank; their confidence is ``counts``."""
    return _hash_join(probe, kb, pairs, text.deep_normalise, counts)


def deep_matched(probe: DataFrame, kb: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The rows of ``probe`` that ``deep_join`` gives a partner, each once."""
    left, right = keyed(probe, [a for a, _ in pairs], side="a"), keyed(kb, [b for _, b in pairs], side="b")
    return left.join(right.select("key_hash").distinct(), "key_hash", "left_semi").drop("key_hash")


def keyed(df: DataFrame, columns: list[str], normalise: Callable[[Column], Column] = text.deep_normalise, side: str = "") -> DataFrame:
    """``df`` with ``key_hash`` of its normalised columns."""
    return df.withColumn("key_hash", text.key_hash(*[normalise(F.col(c)) for c in columns], side=side))


def first_of_key(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """J03 within one table: key, first (the least ``key`` with the same deep-normalised columns), of rows that aren't it.

    Keys are made once and written; the least of each is found by pre-aggregation, and the join back leaves a key of many rows to as many tasks as its size asks for.
    """
    rows = written(keyed(df.select(key, *columns), columns).select(key, "key_hash").where(text.is_key(F.col("key_hash"))), "keyed")
    least = rows.groupBy("key_hash").agg(F.min(key).alias("first"))
    return rows.join(least, "key_hash").where(F.col(key) != F.col("first")).select(key, "first")


def _hash_join(probe: DataFrame, kb: DataFrame, pairs: list[tuple[str, str]], normalise: Callable[[Column], Column], counts: float) -> DataFrame:
    left, right = keyed(probe, [a for a, _ in pairs], normalise, "a"), keyed(kb, [b for _, b in pairs], normalise, "b")
    return left.join(right, "key_hash").drop("key_hash").withColumn("confidence", F.lit(counts))


def blocked_fuzzy(probe: DataFrame, kb: DataFrame, block: str, probe_text: str, kb_text: str, least: float = 0.75, base: float = 0.80, gain: float = 0.12, native: bool = False, same: bool = True) -> DataFrame:
    """Within a block the records whose text is most alike by T04, all ties, at ``least`` or more.

    similarity, confidence = base + gain * similarity. Without ``same`` equal texts don't count. Candidates come from an
    index of the characters that texts share (``similarity``), not from all pairs of a block; a text that repeats in a block is
    compared once. ``native`` uses containment only.
    """
    pairs = similar_pairs(probe, kb, [block], probe_text, kb_text, least)
    if native:
        pairs = pairs.where(F.col(probe_text).contains(F.col(kb_text)) | F.col(kb_text).contains(F.col(probe_text)))
    best = written(best_similar(pairs if same else pairs.where(F.col(probe_text) != F.col(kb_text)), [block, probe_text]), "best")
    # Copies make many pairs of few keys: they are dealt to tasks. Best pairs are of distinct texts.
    both = dealt_join(probe.join(best, [block, probe_text]), kb, [block, kb_text])
    return both.withColumn("confidence", confidence(base, gain, F.col("similarity")))


def staged(probe: DataFrame, key: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """``stages`` are (name, function from the rows left to matches with ``key``); stage is added to the matches.

    All matches of the first stage that matches a row are returned. Each stage's matches are written once and read for
    the result and for what is left, so no stage is computed again by those after it.
    """
    left, found = probe, []
    for n, (name, match) in enumerate(stages):
        hit = match(left).withColumn("stage", F.lit(name))
        if n + 1 < len(stages):
            hit = written(hit, f"stage-{name}")
            left = left.join(hit.select(key).distinct(), key, "left_anti")
        found.append(hit)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def last_wins(df: DataFrame, lookup: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Left join to the last record of each key."""
    last = lookup.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    return df.join(last, keys, "left")


def fill_gaps(df: DataFrame, have: DataFrame, keys: list[str], placeholder: dict[str, Column]) -> DataFrame:
    """Keys of ``df`` that ``have`` lacks, with placeholder columns."""
    return df.join(have.select(*keys).distinct(), keys, "left_anti").select(*keys, *[c.alias(n) for n, c in placeholder.items()])


def anti_either(df: DataFrame, other: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Rows that match neither on all ``keys`` nor on ``key`` alone."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti").join(other.select(key).distinct(), key, "left_anti")


def overlap(df: DataFrame, other: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with and without a partner."""
    marks = other.select(*keys).distinct()
    return df.join(marks, keys, "left_semi"), df.join(marks, keys, "left_anti")


def longest_keyword(df: DataFrame, key: str, text_column: str, words: DataFrame) -> DataFrame:
    """Of the words that a text holds the longest, then the first by seq and word: words (word, label, seq). ``key`` names the rows, which are unique by it."""
    sized = words.withColumn("__less", -F.length("word"))
    return keywords.hits(df, F.col(text_column), sized, ["__less", "seq", "word"], first=True).drop("__less")


def keyword_hits(df: DataFrame, text_column: str, words: DataFrame) -> DataFrame:
    """Words of up to three letters match the whole field or an ASCII token; longer ones any part."""
    return keywords.hits(df, F.col(text_column), words, ["word"], tokens=True)


def keyword_outcomes(df: DataFrame, key: str, text_column: str, words: DataFrame, out: str = "labels") -> DataFrame:
    """``key`` and the labels of all words that a text holds, each once, in the order of the list (word, label, seq); rows without one have none. ``key`` names the rows, which are unique by it."""
    return keywords.labels(df, key, F.col(text_column), words).withColumnRenamed("labels", out)


def upsert(df: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Blanks of known keys are filled, unknown keys come in."""
    b = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    filled = [F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"__{c}")).alias(c) for c in columns]
    return df.join(b, keys, "full").select(*keys, *filled)


def insert_absent(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there come in; a second run changes nothing."""
    return df.unionByName(new.dropDuplicates(keys).join(df.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both runs by id; ``unpaired`` marks ids of one side, which a comparison must not have."""
    both = a.withColumn("__l", F.lit(True)).join(b.withColumn("__r", F.lit(True)), key, "full")
    return both.withColumn("unpaired", F.col("__l").isNull() | F.col("__r").isNull()).drop("__l", "__r")


def strictly_paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """J15 as a check: the paired rows, or an error at run time that names an id of one side."""
    both = paired(a, b, key)
    fail = F.raise_error(F.concat(F.lit(f"unpaired {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return both.where(F.when(F.col("unpaired"), fail).otherwise(F.lit(True))).drop("unpaired")


def leakage(held_out: DataFrame, known: DataFrame, id_column: str, held_text: str, known_id: str, known_text: str) -> DataFrame:
    """Held-out keys among known ones under two normalisations: ids and the normalisation, each once."""

    def variants(df: DataFrame, id_: str, column: str, name: str) -> DataFrame:
        plain, deep = text.normalise(F.col(column)), text.deep_normalise(F.col(column))
        pairs = F.array(F.struct(F.lit("exact").alias("kind"), text.key_hash(plain, side=name).alias("variant")), F.struct(F.lit("deep").alias("kind"), text.key_hash(deep, side=name).alias("variant")))
        return df.select(F.col(id_).alias(name), F.inline(pairs))

    return variants(held_out, id_column, held_text, "held_id").join(variants(known, known_id, known_text, "known_id"), ["kind", "variant"]).select("held_id", "known_id", "kind").distinct()


def left_best(df: DataFrame, recommendations: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """Every row of a sheet with the best-scored recommendation of its number, the first of equals; rows without one keep nulls."""
    return df.join(best_scored(recommendations, [key], score, seq).drop(score, seq), key, "left")


def cross_references(templates: DataFrame, updates: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, value) of the variables that a rule refers to another sheet, on sheets that have updates but for the source itself.

    templates: sheet, variable, row, col; updates: sheet; rules: variable, source_sheet, value, a table that people write.
    """
    touched = updates.select("sheet").distinct()
    hits = templates.join(rules, "variable").where(F.col("sheet") != F.col("source_sheet"))
    return hits.join(touched, "sheet", "left_semi").select("sheet", "row", "col", "value")


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The distinct values of ``key`` that ``other`` lacks."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(other.select(key), key, "left_anti")
