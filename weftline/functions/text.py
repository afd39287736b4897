"""Scalar text functions as column expressions; Python only where Spark has no equivalent."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: English words that carry no meaning in a variable name.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
#: The masking patterns in the order in which they apply, and the marker.
MASKS = (
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b[A-Z]*\d{3,4}-\d{3,4}\b",
    r"\b[A-Z][a-z]+,\s*[A-Z][a-z]+\b",
    r"(?i)(?:DOB|birth|born|date of birth)[:\s]*\d{4}-\d{2}-\d{2}",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
)
MARKER = "[REDACTED]"
#: Unicode white space.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Bracketed text, slashes, and punctuation, which deep normalisation removes together with white space.
BRACKETED, SLASHES, PUNCTUATION = r"[（(][^)）]*[)）]", "/／\\", "_-—–·.。、,，;；:："


def blank(c: Column) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def normalise(c: Column) -> Column:
    """Null to '', outer Unicode white space off, lower case."""
    return F.lower(F.btrim(blank(c), F.lit(WHITE)))


def deep_normalise(c: Column) -> Column:
    """T01, then bracketed text, slashes, white space and punctuation go."""
    return F.translate(F.regexp_replace(normalise(c), BRACKETED, ""), SLASHES + WHITE + PUNCTUATION, "")


def composite_key(*cols: Column) -> Column:
    """Normalised parts joined by a triple pipe; '' if a part is blank."""
    parts = [normalise(c) for c in cols]
    filled = parts[0] != ""
    for p in parts[1:]:
        filled = filled & (p != "")
    return F.when(filled, F.concat_ws("|||", *parts)).otherwise("")


def key_hash(*parts: Column, side: str = "") -> Column:
    """One hash (MD5) for normalised parts joined by a triple pipe: a join key that stays short however long the parts are.

    A key with a blank part matches nothing: it is no hash but ``side`` and the number of the partition, which no other
    side has and which deals such rows out. So the key is never null, no join puts a filter on it below the
    projection, and long texts are normalised once.
    """
    joined = F.get(F.transform(F.array(F.array(*parts)), lambda ps: F.when(~F.exists(ps, lambda p: p == ""), F.md5(F.array_join(ps, "|||")))), F.lit(0))
    return F.coalesce(joined, F.concat(F.lit(f"{side}-"), F.spark_partition_id().cast("string")))


def is_key(key: Column) -> Column:
    """Whether ``key_hash`` is a hash."""
    return ~key.contains("-")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def containment(a: Column, b: Column) -> Column:
    """The native part of T04: 1 if equal, the ratio of lengths if one holds the other, else null; 0 if one is blank."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), short / long)


def fuzzy_score(a: Column, b: Column) -> Column:
    """Containment first, else the Ratcliff-Obershelp ratio. Block candidates before the call: the ratio runs in Python."""
    return F.coalesce(containment(a, b), ratio(a, b))


def key_terms(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words longer than two letters, without stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(blank(c)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: ~w.isin(*stop) & (F.length(w) > 2))


def naming_score(name: Column, prefix: Column) -> Column:
    """0 if blank or over eight characters; else 0.3, and 0.4 for the prefix, and 0.3 for capitals, digits and underscores only."""
    n, p = blank(name), blank(prefix)
    part = lambda test, points: F.when(test, points).otherwise(0.0)
    return F.when((n == "") | (F.length(n) > 8), 0.0).otherwise(F.round(0.3 + part((p != "") & n.startswith(p), 0.4) + part(n.rlike("^[A-Z0-9_]+$"), 0.3), 4))


def split_condition(c: Column) -> Column:
    """Variable, condition and tested value of ``VAR when COND``."""
    parts = F.split(blank(c), r"(?i)\s+when\s+", 2)
    condition = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    value = F.regexp_extract(condition, r"=\s*\"?([^\"=]+?)\"?\s*$", 1)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("variable"), F.trim(condition).alias("condition"), F.trim(value).alias("value"))


def first_valid(domains: Column, variables: Column, valid: list[str]) -> Column:
    """Of pipe lists the first valid domain and the variable at its place (the last one if the list is shorter)."""
    d = F.transform(F.split(blank(domains), r"\|"), lambda x: F.upper(F.trim(x)))
    v = F.transform(F.split(blank(variables), r"\|"), lambda x: F.trim(x))
    hit = F.get(F.filter(d, lambda x: x.isin(*valid)), F.lit(0))
    at = F.array_position(d, hit)
    return F.struct(hit.alias("domain"), F.when(hit.isNotNull(), F.get(v, (F.least(at, F.size(v)) - 1).cast("int"))).alias("variable"))


def stable_token(c: Column, width: int = 8) -> Column:
    """A legal name of at most ``width`` characters: capitals and digits with a letter in front; what is too long or
    loses other letters keeps four characters (or Q) and is filled from the text's SHA-256."""
    text = F.upper(F.regexp_replace(blank(c), r"(?U)^\s+|\s+$", ""))
    plain = F.regexp_replace(text, "[^A-Z0-9]", "")
    named = F.when(plain.rlike("^[0-9]"), F.concat(F.lit("Q"), plain)).otherwise(plain)
    loses = F.regexp_replace(text, r"[\x00-\x7F]", "").rlike(r"[\p{L}\p{N}]")
    front = F.when(named != "", F.substring(named, 1, 4)).otherwise("Q")
    digest = F.upper(F.sha2(text, 256))
    return F.when(text == "", "").when((named != "") & (F.length(named) <= width) & ~loses, named).otherwise(F.concat(front, F.substring(digest, F.lit(1), width - F.length(front))))


def diff_status(domain: Column, variable: Column, ref_domain: Column, ref_variable: Column) -> Column:
    """How a result and its reference differ; a side counts if both its fields are filled, and neither side is ai_only."""
    d, v, rd, rv = (F.trim(blank(c)) for c in (domain, variable, ref_domain, ref_variable))
    own, ref = (d != "") & (v != ""), (rd != "") & (rv != "")
    return F.when(~ref, "ai_only").when(~own, "ref_only").when(d != rd, "domain_diff").when(v != rv, "var_diff").otherwise("match")


def labels(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Names of the patterns that a text shows, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(blank(text).rlike(pattern), F.lit(name)) for name, pattern in rules]))


def weighted_length(c: Column) -> Column:
    """Characters, with CJK ones counting three."""
    return F.length(blank(c)) + 2 * F.regexp_count(blank(c), F.lit(r"[㐀-䶿一-鿿豈-﫿　-〿＀-￯]"))


def mask(c: Column) -> Column:
    """The masking patterns, one after the other. Words and white space are those of ASCII: an accented letter behind a name or a number ends it, so what stands before is masked."""
    for pattern in MASKS:
        # Java's \b sees all letters, and its \s the vertical tab.
        ascii_ = pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))").replace(r"[:\s]", r"[:\t\n\f\r ]").replace(r"\s", r"[\t\n\f\r ]")
        c = F.regexp_replace(c, ascii_, MARKER)
    return c


def mask_map(c: Column) -> Column:
    """T35 for each value of a map."""
    return F.transform_values(c, lambda _, v: mask(v))


def fingerprint(*cols: Column) -> Column:
    """SHA-256 of the normalised parts as a JSON list."""
    return F.sha2(F.to_json(F.array(*[normalise(c) for c in cols])), 256)


def chunk(parts: list[tuple[str, Column]], most: int = 800, least: int = 10) -> Column:
    """``label: value`` lines of the filled parts, cut at ``most`` characters; null under ``least``."""
    lines = [F.when(F.trim(blank(c)) != "", F.concat(F.lit(f"{label}: "), F.trim(c))) for label, c in parts]
    text = F.substring(F.concat_ws("\n", *lines), 1, most)
    return F.when(F.length(text) >= least, text)


def json_field(c: Column, path: str) -> Column:
    """A field of the first JSON object in a text, fences around it or not."""
    return F.get_json_object(F.regexp_extract(blank(c), r"(?s)(\{.*\})", 1), path)


def band(score: Column) -> Column:
    """Colour band of a score."""
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")


def label_line(c: Column) -> Column:
    """What stands behind ``label:`` on a line of its own."""
    return F.trim(F.regexp_extract(blank(c), r"(?im)^label:(.*)$", 1))


def clean_label(c: Column) -> Column:
    """White space to one space, numbering in front and colons behind off."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(blank(c), r"(?U)\s+", " "), r"^\s*\d+[.)、]\s*", ""), r"[:：]\s*$", ""))


def filled(*cols: Column) -> Column:
    """whether all required fields are there."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & (blank(c) != "")
    return ok


def report_label(c: Column, allowed: tuple[str, ...]) -> Column:
    """F16: a label in capitals if it is one of the allowed ones, else OTHER; a blank one is UNRECORDED."""
    label = F.upper(F.trim(F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("UNRECORDED"))))
    return F.when(label.isin(*allowed), label).otherwise("OTHER")


def functional_query(role: Column, label: Column) -> Column:
    """The question that a variable of this role and label stands for."""
    said = F.lower(blank(label))
    # The wording of the questions.
    about = lambda what: F.concat(F.lit(what), said)
    return (
        F.when(role == "Identifier", "Map subject identifier field")
        .when(role == "Topic", about("Map the main topic field for "))
        .when(role == "Timing", about("Map timing information for "))
        .when(role == "Qualifier", about("Map qualifier information for "))
        .otherwise(about("Map field for "))
    )


def evaluation_cases(catalogue: DataFrame, domain: str, place: str, name: str, label: str, role: str, kind: str, most: int = 10) -> DataFrame:
    """For the first variables of each domain two questions, one by label and one by role, ``most`` in all: id, type, query, expected_domain, expected_variable, context, number."""
    first = catalogue.withColumn("__n", F.row_number().over(Window.partitionBy(domain).orderBy(place)) - 1).where(F.col("__n") * 2 < most)
    said = lambda c: F.coalesce(F.col(c), F.lit("Unknown"))
    # The wording of questions and contexts.
    direct = F.struct(F.lit("direct_mapping").alias("type"), F.concat(F.lit("Map '"), blank(F.col(label)), F.lit("' to SDTM variable")).alias("query"), F.concat(F.lit("Domain: "), domain, F.lit(", Role: "), said(role)).alias("context"), F.lit("direct").alias("word"), F.lit(0).alias("k"))
    functional = F.struct(F.lit("functional_mapping").alias("type"), functional_query(F.col(role), F.col(label)).alias("query"), F.concat(F.lit("Domain: "), domain, F.lit(", Type: "), said(kind)).alias("context"), F.lit("functional").alias("word"), F.lit(1).alias("k"))
    cases = first.select(domain, name, "__n", F.explode(F.array(direct, functional)).alias("c")).withColumn("number", 2 * F.col("__n") + F.col("c.k")).where(F.col("number") < most)
    return cases.select(F.concat_ws("_", domain, F.col("__n").cast("string"), "c.word").alias("id"), "c.type", "c.query", F.col(domain).alias("expected_domain"), F.col(name).alias("expected_variable"), "c.context", "number")
