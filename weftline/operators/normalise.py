"""Recommendation rows: decomposition, classification, validation with score penalties, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import blank, first_valid, split_condition, stable_token
from weftline.operators.ranking import best_keep_place, score_of
from weftline.operators.similarity import similar_pairs

#: Endings that are stripped before a name is looked up again.
SUFFIXES = ("DESC", "NAME", "CODE", "TEXT", "VALUE", "LABEL", "NUM", "IND")

#: Variables of every supplementary data set, which no qualifier may be named like.
SUPP_VARIABLES = ("RDOMAIN", "IDVAR", "IDVARVAL", "QNAM", "QLABEL", "QVAL", "QORIG", "QEVAL")


def classify(domain: Column, variable: Column) -> Column:
    """not_submitted, supp or standard."""
    return F.when(F.upper(blank(variable)).contains("NOT SUBMITTED"), "not_submitted").when(F.upper(blank(domain)).startswith("SUPP"), "supp").otherwise("standard")


def decompose(df: DataFrame, valid: list[str], most: int = 5) -> DataFrame:
    """The first ``most`` rows of each input (key, seq, domain, variable, score), with one valid domain, the bare variable, its test code, and QNAM for supplementary rows."""
    capped = df.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where(F.col("__n") <= most).drop("__n")
    one = capped.withColumn("__f", first_valid(F.col("domain"), F.col("variable"), valid))
    parts = one.withColumn("__c", split_condition(F.coalesce(F.col("__f.variable"), F.col("variable"))))
    kind = classify(F.col("domain"), F.col("variable"))
    out = parts.select("key", "seq", F.coalesce("__f.domain", "domain").alias("domain"), F.upper(F.col("__c.variable")).alias("variable"), F.col("__c.value").alias("testcd"), kind.alias("kind"), score_of(F.col("score")).alias("score"))
    return out.withColumn("qnam", F.when(F.col("kind") == "supp", stable_token(F.when(F.col("testcd") != "", F.col("testcd")).otherwise(F.col("variable")))))


def validate(rows: DataFrame, catalogue: DataFrame, valid: list[str]) -> DataFrame:
    """Membership of (domain, variable) in the catalogue, and penalties: an unknown domain 0.7 of the score and 0.6 at most, a name over eight characters is cut and keeps 0.6 and 0.5 at most. check: Pass, Fail, Skip."""
    known = catalogue.select(F.col("domain"), F.col("variable"), F.lit(True).alias("__in")).distinct()
    checked = rows.withColumn("long", F.length("variable") > 8).withColumn("variable", F.substring("variable", 1, 8)).join(known, ["domain", "variable"], "left")
    bad = ~F.col("domain").isin(*valid) & (F.col("kind") != "supp")
    s = F.when(bad, F.least(F.col("score") * 0.7, F.lit(0.6))).otherwise(F.col("score"))
    s = F.when(F.col("long"), F.least(s * 0.6, F.lit(0.5))).otherwise(s)
    check = F.when(F.col("kind") != "standard", "Skip").when(F.col("__in"), "Pass").otherwise("Fail")
    return checked.withColumn("score", F.round(s, 4)).withColumn("check", check).drop("__in")


def demote(rows: DataFrame) -> DataFrame:
    """Standard rows that aren't in the catalogue become supplementary, with 0.8 of the score and 0.7 at most."""
    hit = (F.col("kind") == "standard") & (F.col("check") == "Fail")
    rows = rows.withColumn("qnam", F.when(hit, stable_token(F.col("variable"))).otherwise(F.col("qnam"))).withColumn("score", F.when(hit, F.round(F.least(F.col("score") * 0.8, F.lit(0.7)), 4)).otherwise(F.col("score")))
    return rows.withColumn("domain", F.when(hit, F.concat(F.lit("SUPP"), "domain")).otherwise(F.col("domain"))).withColumn("kind", F.when(hit, "supp").otherwise(F.col("kind")))


def normalise(df: DataFrame, catalogue: DataFrame, valid: list[str]) -> DataFrame:
    """The whole chain in the order of the live path: cap, decompose, resolve, classify, validate, demote, best of each target."""
    rows = demote(validate(decompose(df, valid), catalogue, valid))
    return best_keep_place(rows, ["key", "domain", "variable", "testcd", "qnam"], "score", "seq")


def closest_name(rows: DataFrame, catalogue: DataFrame, least: float = 0.6) -> DataFrame:
    """A name that isn't in its domain: without one of the endings if that is there, else the most alike name of the domain. rows: domain, variable."""
    names = rows.select("domain", "variable").distinct()
    bare = F.regexp_replace("variable", f"(?:{'|'.join(SUFFIXES)})$", "")
    known = catalogue.select("domain", F.col("variable").alias("name")).distinct()
    there = names.withColumn("name", bare).join(known, ["domain", "name"]).select("domain", "variable", "name", F.lit(1.0).alias("ratio"))
    alike = similar_pairs(names, known, ["domain"], "variable", "name", least, contained=False).withColumnRenamed("similarity", "ratio")
    scored = there.unionByName(alike.select("domain", "variable", "name", "ratio"))
    w = Window.partitionBy("domain", "variable").orderBy(F.desc("ratio"), "name")
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").select("domain", "variable", F.col("name").alias("closest"), F.round("ratio", 4).alias("ratio"))


def supp_records(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Supplementary rows as the contract wants them: sdtm_variable QVAL, kind supp, a legal supp_variable, and supp_dataset.

    rows: domain, variable_name, supp_variable, sdtm_variable, auto_corrected, supp_dataset. The qualifier is the first
    candidate whose token is legal and neither a supplementary nor a standard variable of the base domain: the given
    one, the variable's name and the target, the name before the given one in corrected rows; else a token of the name made unlike any.
    """
    base = F.regexp_replace(F.upper(F.trim(blank(F.col("domain")))), "^SUPP", "")
    # A domain's variables are a short list that people write.
    names = catalogue.groupBy(F.col("domain").alias("__base")).agg(F.collect_set("variable").alias("__standard"))
    both = rows.withColumn("__base", base).join(names, "__base", "left")
    given, name, target = (stable_token(F.col(c)) for c in ("supp_variable", "variable_name", "sdtm_variable"))
    candidates = F.when(F.coalesce("auto_corrected", F.lit(False)), F.array(name, given, target)).otherwise(F.array(given, name, target))
    taken = lambda t: t.isin(*SUPP_VARIABLES) | F.coalesce(F.array_contains(F.col("__standard"), t), F.lit(False))
    first = F.get(F.filter(candidates, lambda t: t.rlike("^[A-Z][A-Z0-9]{0,7}$") & ~taken(t)), F.lit(0))
    made = F.when(taken(name), stable_token(F.concat(F.lit("SUPP|"), blank(F.col("variable_name"))))).otherwise(name)
    qualifier = F.coalesce(first, F.nullif(made, F.lit("")), F.lit("COMMENT"))
    dataset = F.when(F.col("__base") != "", F.concat(F.lit("SUPP"), "__base")).otherwise(F.coalesce(F.nullif(F.col("supp_dataset"), F.lit("")), F.lit("SUPPXX")))
    out = both.withColumn("supp_variable", qualifier).withColumn("supp_dataset", dataset)
    return out.withColumn("sdtm_variable", F.lit("QVAL")).withColumn("kind", F.lit("supp")).drop("__base", "__standard")


def cleaned(rows: DataFrame) -> DataFrame:
    """the columns that leave the chain; those of supplementary data sets are null for all other rows."""
    supp = F.lower(blank(F.col("kind"))) == "supp"
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("domain", "sdtm_variable", "kind")]
    own = [F.when(supp, F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("supp_dataset", "supp_variable")]
    return rows.select(*filled, F.coalesce("score", F.lit(0.9)).alias("score"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("testcd", "source")], "variable_name", *own)
