"""The cascade decision: the first level whose evidence is strong enough answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPT, SURE, RETRIEVED = 0.80, 0.85, 0.70


def level(kb: Column, exact: Column, retrieved: Column, accept: float = ACCEPT, sure: float = SURE, good: float = RETRIEVED) -> Column:
    """1 a sure or exact record match, 2 an accepted one, 3 a good retrieved text, else 4 (to be inferred)."""
    k, r = F.coalesce(kb, F.lit(0.0)), F.coalesce(retrieved, F.lit(0.0))
    return F.when((k >= accept) & (exact | (k >= sure)), 1).when(k >= accept, 2).when(r >= good, 3).otherwise(4)


def source(level_: Column) -> Column:
    """the source that a level stands for."""
    return F.when(level_.isin(1, 2), "KB").when(level_ == 3, "RAG").when(level_ == 4, "LLM").otherwise("UNMAPPED")


def live_cascade(inputs: DataFrame, suggestions: DataFrame, contexts: DataFrame, default: float = 0.9) -> DataFrame:
    """The rows with which the first level that answers does so: key, level, source, domain, variable, score, seq.

    inputs: key, confidence (of its record match), direct (an exact one). suggestions and contexts: key, seq, domain,
    variable, score. Levels 1 and 2 give the suggestions; level 3 the retrieved rows, with the suggestions appended, a
    suggestion without a score counting the confidence; level 4 gives one row without a target, to be inferred. Suggestions
    without a score count ``default`` on level 1. An input without suggestions has no record match.
    """
    has = suggestions.select("key", F.lit(True).alias("__kb")).distinct()
    top = contexts.groupBy("key").agg(F.max("score").alias("__top"))
    known = inputs.join(has, "key", "left").join(top, "key", "left")
    kb = F.when(F.col("__kb"), F.col("confidence"))
    levels = known.select("key", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), level(kb, F.coalesce("direct", F.lit(False)), F.col("__top")).alias("level"))
    own = F.when(F.col("level") == 1, F.lit(default)).otherwise(F.col("confidence"))
    from_records = levels.where("level <= 3").join(suggestions, "key").select("key", "level", F.lit("KB").alias("source"), "domain", "variable", F.coalesce("score", own).alias("score"), (F.col("seq") + F.when(F.col("level") == 3, 1 << 32).otherwise(0)).alias("seq"))
    retrieved = levels.where("level = 3").join(contexts, "key").select("key", "level", F.lit("RAG").alias("source"), "domain", "variable", "score", F.col("seq").cast("long").alias("seq"))
    nothing = F.lit(None)
    inferred = levels.where("level = 4").select("key", "level", F.lit("LLM").alias("source"), nothing.cast("string").alias("domain"), nothing.cast("string").alias("variable"), nothing.cast("double").alias("score"), F.lit(0).cast("long").alias("seq"))
    return from_records.unionByName(retrieved).unionByName(inferred)
