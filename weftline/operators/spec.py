"""Specification building: ordered string aggregation, rule tables, and the grammar of composite mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_strings(df: DataFrame, keys: list[str], value: str, *order: str, separator: str = ";\n") -> DataFrame:
    """The distinct values of each key in order of first occurrence, joined."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("o"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value].cast("string")), separator).alias("text"), F.count("*").alias("n"))


def nested_strings(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """``group: values`` of each key; groups and values sorted, a blank group first and bare."""
    inner = df.groupBy(*keys, group).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ", ").alias("v"))
    line = F.when(F.col(group) == "", F.col("v")).otherwise(F.concat_ws(": ", group, "v"))
    return inner.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(group), line.alias("l")))), lambda x: x["l"]), "; ").alias("text"))


def source_sets(df: DataFrame, domains: str, source: str) -> DataFrame:
    """Per domain of a pipe list the sorted set of sources."""
    each = df.select(F.explode(F.split(domains, r"\|")).alias("domain"), source).withColumn("domain", F.trim("domain")).where("domain <> ''")
    return each.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set(F.col(source).cast("string"))), ", ").alias("sources"), F.count_distinct(source).alias("n"))


def first_rule(df: DataFrame, key: str, value: str, rules: DataFrame) -> DataFrame:
    """Rules (seq, kind exact | pattern, test, outcome); the first that fits a value gives the outcome.

    The rule table is written by people and broadcast; over 10,000 rows it is refused.
    """
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("rule tables are broadcast and may have 10,000 rows at most")
    fits = F.when(F.col("kind") == "exact", F.col(value) == F.col("test")).otherwise(F.expr(f"{value} rlike test"))
    hits = df.join(F.broadcast(rules), fits)
    return hits.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where("r = 1").drop("r")


def parse_mappings(domains: Column, variables: Column) -> Column:
    """The mappings that a pipe list of domains and a pipe list of variables say, as array<struct>.

    Variables pair with domains by place, the last domain serving the rest; ``A / B`` are two variables of a domain, and a
    condition behind the last of them holds for both. kind: not_submitted, assignment (``V = x``), conditional (``V when
    C``), supp (a SUPP domain, or ``QVAL when QNAM = x``) or simple.
    """
    d = F.transform(F.split(F.coalesce(domains, F.lit("")), r"\|"), lambda x: F.upper(F.trim(x)))
    v = F.split(F.coalesce(variables, F.lit("")), r"\|")

    def of_part(part: Column, at: Column) -> Column:
        domain = F.get(d, F.least(at, F.size(d) - 1))
        names = F.split(part, r"\s*/\s*")
        shared = F.trim(F.regexp_extract(F.element_at(names, -1), r"(?i)^.*?\s+(?:when|if)\s+(.*)$", 1))

        def one(name: Column) -> Column:
            own = F.trim(F.regexp_extract(name, r"(?i)^.*?\s+(?:when|if)\s+(.*)$", 1))
            condition = F.when(own != "", own).otherwise(shared)
            bare = F.trim(F.regexp_replace(name, r"(?i)\s+(?:when|if)\s+.*$", ""))
            variable = F.upper(F.trim(F.regexp_extract(bare, r"^([^=]*)", 1)))
            assigned = F.trim(F.regexp_extract(bare, r"=\s*(.*)$", 1))
            qnam = F.upper(F.trim(F.regexp_extract(condition, r"(?i)QNAM\s*=\s*[\"']?([A-Za-z0-9_]+)", 1)))
            kind = (
                F.when(F.upper(bare).contains("NOT SUBMITTED"), "not_submitted").when(domain.startswith("SUPP") | (qnam != ""), "supp").when(assigned != "", "assignment").when(condition != "", "conditional").otherwise("simple")
            )
            return F.struct(domain.alias("domain"), variable.alias("variable"), kind.alias("kind"), condition.alias("condition"), assigned.alias("assigned"), qnam.alias("qnam"))

        return F.transform(names, one)

    return F.filter(F.flatten(F.transform(v, of_part)), lambda m: m["variable"] != "")


#: What parts an expression, and what stands for it inside quotes while it is parsed.
PARTING, QUOTED = "|/= ", "\ue000\ue001\ue002\ue003"


def quoted_safe(c: Column) -> Column:
    """The text with what would part it, inside double quotes, replaced by stand-ins; ``plain_again`` puts it back. An open quote quotes nothing."""
    pieces = F.split(F.coalesce(c, F.lit("")), '"')
    inside = lambda i: (i % 2 == 1) & (i < F.size(pieces) - 1)
    return F.array_join(F.transform(pieces, lambda s, i: F.when(inside(i), F.translate(s, PARTING, QUOTED)).otherwise(s)), '"')


def plain_again(c: Column) -> Column:
    return F.translate(c, QUOTED, PARTING)


def grammar(domains: Column, variables: Column) -> Column:
    """The whole grammar of mappings: array<struct<domain, variable, kind, condition, qnam>>, in order.

    ``|`` pairs variables with domains by place, the last domain serving the rest; ``/`` parts the variables of a domain. A
    condition (``when`` or ``if``) behind the last ``/`` holds for all variables of its group, unless the group begins with an
    assignment, whose parts each have their own. kind: assignment (``V=x``, its value in condition), simple, supp (``QVAL`` with a QNAM), conditional (a test or
    test code is asked) or conditional_other. White space counts once, and none around ``=``; inside double quotes nothing parts.
    """
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.trim(quoted_safe(c)), r"(?U)\s+", " "), r" ?= ?", "=")
    said, places = clean(variables), F.transform(F.split(clean(domains), r"\|"), lambda x: F.upper(F.trim(x)))
    whole = F.upper(clean(domains))
    condition = r"(?Ui)^(.*?)\s+(when|if)\s+(.*)$"

    def one(domain: Column, text: Column) -> Column:
        assigned = text.rlike(r"(?U)^[A-Za-z_]\w*=.+$")
        name, word, asked = (F.trim(F.regexp_extract(text, condition, k)) for k in (1, 2, 3))
        conditional = ~assigned & (name != "") & (asked != "")
        variable = F.upper(F.trim(F.when(assigned, F.regexp_extract(text, r"(?U)^([A-Za-z_]\w*)=", 1)).when(conditional, name).otherwise(text)))
        first = F.upper(F.regexp_extract(asked, r"(?U)^(\w+)\s*=", 1))
        supp = conditional & (variable == "QVAL") & F.upper(asked).contains("QNAM")
        kind = F.when(assigned, "assignment").when(supp, "supp").when(conditional & first.rlike("TEST(CD)?$"), "conditional").when(conditional, "conditional_other").otherwise("simple")
        told = F.when(assigned, F.trim(F.regexp_extract(text, r"(?U)^[A-Za-z_]\w*=(.+)$", 1))).when(conditional, F.concat_ws(" ", word, asked))
        qnam = F.when(supp, F.nullif(F.upper(F.regexp_extract(asked, r'(?Ui)QNAM="?([\w\ue000-\ue003]+)', 1)), F.lit("")))
        return F.struct(domain.alias("domain"), plain_again(variable).alias("variable"), kind.alias("kind"), plain_again(told).alias("condition"), plain_again(qnam).alias("qnam"))

    def group(domain: Column, text: Column) -> Column:
        parts = F.split(text, "/")
        own = text.rlike(r"(?U)^[A-Za-z_]\w*=") | ~text.contains("/")
        # A condition is shared if the first one of the group stands behind its last slash.
        shared = F.when(~own & ~F.regexp_extract(text, condition, 1).isin("") & ~F.regexp_extract(text, condition, 3).contains("/"), F.concat_ws(" ", F.regexp_extract(text, condition, 2), F.regexp_extract(text, condition, 3)))
        names = F.when(shared.isNotNull(), F.split(F.regexp_extract(text, condition, 1), "/")).otherwise(parts)
        said_ = F.transform(names, lambda v: F.when(shared.isNotNull() & ~v.rlike(r"(?Ui)\b(?:when|if)\b") & (F.trim(v) != ""), F.concat_ws(" ", F.trim(v), shared)).otherwise(F.trim(v)))
        return F.transform(F.filter(F.when(own & ~text.contains("/"), F.array(text)).otherwise(said_), lambda v: v != ""), lambda v: one(domain, v))

    several = said.contains("|")
    groups = F.transform(F.split(said, r"\|"), lambda v, i: F.struct(F.trim(v).alias("v"), F.get(places, F.least(i, F.size(places) - 1)).alias("d")))
    pairs = F.when(several, groups).otherwise(F.array(F.struct(said.alias("v"), whole.alias("d"))))
    return F.flatten(F.transform(F.filter(pairs, lambda g: (g["v"] != "") & (g["d"] != "")), lambda g: group(g["d"], g["v"])))
