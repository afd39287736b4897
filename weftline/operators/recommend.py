"""Suggestions: keyword scoring, validation, retrieved contexts, and a pluggable model with its fallback."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import blank, naming_score
from weftline.session import written


def suggestion_score(query: Column, context: Column, name: Column, label: Column, role: Column, core: Column) -> Column:
    """0.4 for the query in the name, 0.3 in the label, 0.2 for the role in the context, 0.1 if required."""
    q, c = F.lower(blank(query)), F.lower(blank(context))
    part = lambda test, points: F.when(test, points).otherwise(0.0)
    return F.round(
        part((q != "") & F.lower(blank(name)).contains(q), 0.4) + part((q != "") & F.lower(blank(label)).contains(q), 0.3) + part((c != "") & (blank(role) != "") & c.contains(F.lower(blank(role))), 0.2) + part(core == "Req", 0.1), 4
    )


def ranked(suggestions: DataFrame, key: str, score: str, seq: str, k: int = 10) -> DataFrame:
    """The best ``k`` of each key, first come first among equals."""
    return suggestions.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), seq))).where(F.col("rank") <= k)


def validation_score(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """0.3 if the domain is in the catalogue, 0.5 if the variable is in that domain, and 0.2 of the naming score. rows: domain, variable."""
    domains = catalogue.select("domain", F.lit(1).alias("__d")).distinct()
    names = catalogue.select("domain", "variable", F.lit(1).alias("__v")).distinct()
    both = rows.join(domains, "domain", "left").join(names, ["domain", "variable"], "left")
    part = lambda c, points: F.when(F.col(c).isNotNull(), points).otherwise(0.0)
    return both.withColumn("validity", F.round(part("__d", 0.3) + part("__v", 0.5) + 0.2 * naming_score(F.col("variable"), F.col("domain")), 4)).drop("__d", "__v")


def rejected_qualifiers(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """retrieved rows whose qualifier is no variable of the catalogue."""
    return rows.join(catalogue.select(F.col("variable").alias("qnam")).distinct(), "qnam", "left_anti")


def embed_distinct(df: DataFrame, column: str, model: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """Text, embedding for the distinct filled texts, in batches; ``model`` runs on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"text": part["text"], "embedding": model(part["text"].tolist())})

    texts = df.select(F.col(column).alias("text")).where(F.trim("text") != "").distinct()
    return texts.mapInPandas(run, "text string, embedding array<double>")


def embedded(df: DataFrame, column: str, store: str, model: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """V05 with a store of single texts: text, embedding of the distinct filled texts of ``column``; only those that ``store`` lacks are embedded.

    The store is an append-only table keyed by the SHA-256 of a text, so runs share it. A batch that fails leaves its texts out, of this run
    and of the store, and the others in: the next run tries them again. A text that two runs add at once is there twice and counts once.
    """
    spark = df.sparkSession
    texts = df.select(F.col(column).alias("text")).where(F.trim("text") != "").distinct().select(F.sha2("text", 256).alias("id"), "text")
    schema = "id string, text string, embedding array<double>"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    known = (lambda: spark.read.schema(schema).parquet(store)) if there else (lambda: spark.createDataFrame([], schema))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    yield part.assign(embedding=model(part["text"].tolist()))
                except Exception:  # any failure of a model leaves the batch for the next run
                    continue

    new = texts.join(known().select("id"), "id", "left_anti")
    new.mapInPandas(run, schema).write.mode("append").parquet(store)
    stored = spark.read.schema(schema).parquet(store)
    return texts.select("id").join(stored, "id").dropDuplicates(["id"]).select("text", "embedding")


def cached(spark: SparkSession, folder: str, signature: Column, df: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` gives for ``df``, kept as Parquet under the signature of the data: an equal table is read, not made again."""
    name = df.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64(signature).cast("decimal(20,0)")).cast("string")), 256)).first()[0]
    path = f"{folder}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def infer(rows: DataFrame, key: str, prompt: str, model: Callable[[str], str], retries: int = 1) -> DataFrame:
    """Key, answer, failed by a model function on the executors; after the last failed try a row is a placeholder, so a bad call never loses one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, failed = [], []
            for text in frame[prompt]:
                answer = None
                for _ in range(retries + 1):
                    try:
                        answer = model(text)
                        break
                    except Exception:  # any failure of a model leads to the placeholder
                        continue
                answers.append(answer)
                failed.append(answer is None)
            yield pd.DataFrame({key: frame[key], "answer": answers, "failed": failed})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, answer string, failed boolean")


#: An answer's best recommendation, as ``infer_targets`` returns it.
TARGETS = "domain string, variable string, score double, source string, tries int, reason string"


def first_object(text: str | None) -> dict | None:
    """The first JSON object of a text that has fields, fences and words around it or not."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            return found if isinstance(found, dict) and found else None
        except ValueError:
            at = text.find("{", at + 1)
    return None


def infer_targets(rows: DataFrame, key: str, prompt: str, name: str, fallback: str, model: Callable[[str, int], str], retries: int = 1) -> DataFrame:
    """Key, domain, variable, score, source, tries, reason: the target that a model gives each row, asked again after a failed call or an answer that is no JSON.

    model(prompt, try) runs on the executors and answers with an object (domain, sdtm_variable, score). After the last try the row has a
    placeholder: the domain in the column ``fallback`` (UNMAPPED if blank), DOMAIN_NAME_PENDING as variable, score 0, source FALLBACK and the reason. No row is lost.
    """

    def ask(text: str) -> tuple[dict | None, int, str | None]:
        reason = None
        for n in range(retries + 1):
            try:
                answer = model(text, n)
            except Exception as e:  # any failure of a model leads to the next try
                reason = type(e).__name__
                continue
            found = first_object(answer)
            if found is not None and isinstance(found.get("domain"), str) and isinstance(found.get("sdtm_variable"), str):
                return found, n + 1, None
            reason = "no JSON" if found is None else "no target"
        return None, retries + 1, reason

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, text, own, domain in zip(frame[key], frame[prompt], frame[name], frame[fallback], strict=True):
                found, tries, reason = ask(text)
                if found is not None:
                    score = found.get("score", 0)
                    out.append((k, found["domain"].strip().upper(), found["sdtm_variable"].strip(), float(score) if isinstance(score, (int, float)) else 0.0, "LLM", tries, None))
                else:
                    target = (domain or "").strip().upper() or "UNMAPPED"
                    out.append((k, target, f"{target}_{own}_PENDING".upper(), 0.0, "FALLBACK", tries, reason))
            yield pd.DataFrame(out, columns=[key, "domain", "variable", "score", "source", "tries", "reason"])

    return rows.select(key, prompt, name, fallback).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, {TARGETS}")


def checked_top(rows: DataFrame, catalogue: DataFrame, key: str, score: str, seq: str, similar: int = 3) -> DataFrame:
    """The best row of each key against the catalogue (domain, variable): validated, validity, issues, suggestions; other rows have nulls.

    rows: key, domain, variable, score, seq. issues name an unknown domain, or a variable that its domain lacks; then
    suggestions are up to ``similar`` variables of the domain that hold the name or lie in it, shortest first.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), seq))
    ordered = rows.withColumn("__top", place == 1)
    top = validation_score(ordered.where("__top").withColumn("domain", F.upper(blank(F.col("domain")))), catalogue)
    lists = catalogue.where(F.col("variable").isNotNull()).groupBy("domain").agg(F.collect_set("variable").alias("__names"))  # a domain's variables are a short list
    known = top.join(lists, "domain", "left")
    there = F.coalesce(F.array_contains("__names", F.col("variable")), F.lit(False))
    named = blank(F.col("variable")) != ""
    like = F.filter("__names", lambda n: F.upper(n).contains(F.upper("variable")) | F.upper("variable").contains(F.upper(n)))
    nearest = F.slice(F.transform(F.array_sort(F.transform(like, lambda n: F.struct(F.length(n).alias("size"), n.alias("name")))), lambda s: s["name"]), 1, similar)
    unknown = F.when((F.col("domain") != "") & F.col("__names").isNull(), F.concat(F.lit("domain "), "domain", F.lit(" not found")))
    absent = F.when(F.col("__names").isNotNull() & named & ~there, F.concat(F.lit("variable "), "variable", F.lit(" not found in "), "domain"))
    none = F.array().cast("array<string>")
    verdict = known.select(key, seq, (there & named).alias("validated"), "validity", F.array_compact(F.array(unknown, absent)).alias("issues"), F.when(absent.isNotNull(), nearest).otherwise(none).alias("suggestions"))
    return rows.join(verdict, [key, seq], "left")


#: Domains that a listing has at most, variables of each, and up to how many hints all variables are listed.
LISTED, VARIABLES, FEW = 6, 8, 2


def variable_listing(hints: DataFrame, catalogue: DataFrame, categories: list[str], default: list[str], said: Callable[[Column], Column] | None = None) -> DataFrame:
    """The domains and variables that are offered for each row: key, category, domain, place, line.

    hints: key, domain, place (null domain: none; a row without any gets ``default``); catalogue: domain, name, category, variable, place. The first ``LISTED`` hints
    count, in groups of ``categories`` in their order. A line names ``VARIABLES`` variables and how many more there are; rows with at most ``FEW`` hints get all of them.
    Domains that the catalogue lacks are left out. ``said``: what the line is returned as, such as its digest.

    A domain has two lines, one with all variables and one with the first; each is made (and ``said``) once, written, and joined when all rows have their places.
    """
    spark = hints.sparkSession
    rows = hints.select("key").distinct()
    given = hints.where("domain is not null")
    counts = given.groupBy("key").agg(F.count("*").alias("n"))
    usual = spark.createDataFrame(list(enumerate(default)), "place int, domain string")
    without = rows.join(counts, "key", "left_anti").withColumn("d", F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(x).alias("domain")) for k, x in enumerate(default)]))).select("key", "d.domain", "d.place") if default else rows.limit(0).crossJoin(usual)
    asked = given.select("key", "domain", F.col("place").cast("int").alias("place")).unionByName(without.select("key", "domain", "place")).join(counts, "key", "left")
    first = asked.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy("place"))).where(F.col("__r") <= LISTED)
    whole = (F.col("n").isNotNull() & (F.col("n") <= FEW)).alias("whole")
    named = catalogue.groupBy("domain").agg(F.first("category").alias("category"))
    known = first.join(named, "domain").select("key", "domain", "category", "__r", whole)
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, categories)), F.col("category")), F.lit(0)), F.lit(len(categories) + 1))
    placed = known.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(order, "__r")))
    # A line may name all variables of its domain, so they are gathered.
    lists = catalogue.groupBy("domain").agg(F.first("name").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("place", "variable"))), lambda v: v["variable"]).alias("names"))
    forms = lists.withColumn("whole", F.explode(F.array(F.lit(True), F.lit(False))))
    most = F.when(F.col("whole"), F.size("names")).otherwise(VARIABLES)
    more = F.size("names") - most
    line = F.concat(F.lit("- "), "domain", F.lit(" ("), "name", F.lit("): "), F.array_join(F.slice("names", F.lit(1), F.greatest(most, F.lit(1))), ", "), F.when(more > 0, F.concat(F.lit(", ... (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    lines = written(forms.select("domain", "whole", (said(line) if said else line).alias("line")), "lines")
    return placed.join(lines, ["domain", "whole"]).select("key", "category", "domain", "place", "line")


def request_volume(rows: DataFrame, level: str, text: str, batch: int = 100) -> DataFrame:
    """Model calls and embedding requests that a batch needs."""
    return rows.agg(F.count_if(F.col(level) == 4).alias("model_calls"), F.ceil(F.count_distinct(F.col(text)) / batch).alias("embedding_requests"))
