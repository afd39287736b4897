"""Queries on the similarity join and the front of strategies, with SQL that compares all pairs of a block."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import front, match, normalise, similarity
from weftline.plans.relational import _DEEP
from weftline.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The ratio of T04 for the rows of ``pairs`` (a, b): the longest common part, first in a, then in b, and again on both sides of it.
_RATIO = """seg AS (SELECT a, b, a AS x, b AS y, 0 AS m FROM (SELECT DISTINCT a, b FROM pairs)
    UNION ALL SELECT a, b, unnest([substr(x, 1, h.i - 1), substr(x, h.i + h.n)]), unnest([substr(y, 1, h.j - 1), substr(y, h.j + h.n)]), unnest([h.n, 0]) FROM (
    SELECT a, b, x, y, list_transform(list_filter(flatten(list_transform(range(length(x), 0, -1), lambda n: list_transform(range(1, length(x) - n + 2), lambda i: {'n': n, 'i': i}))), lambda s: contains(y, substr(x, s.i, s.n)))[1:1], lambda s: {'n': s.n, 'i': s.i, 'j': strpos(y, substr(x, s.i, s.n))})[1] AS h
    FROM seg WHERE x <> '' AND y <> '') WHERE h IS NOT NULL),
    ratios AS (SELECT a, b, CAST(2.0 * sum(m) / (length(a) + length(b)) AS DOUBLE) AS ratio FROM seg GROUP BY a, b),
    scores AS (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE ratio END AS score, ratio FROM ratios)"""


def query(name: str, sql: str):
    """Registers a query (spark, sf_dir) with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query(
    "t04_fuzzy_scores",
    f"""WITH RECURSIVE n AS (SELECT DISTINCT p_brand, lower(p_name) AS t FROM part), pairs AS (SELECT x.p_brand, x.t AS a, y.t AS b FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.t < y.t), {_RATIO}
    SELECT p_brand, a, b, round(score, 6) AS score FROM pairs JOIN scores USING (a, b) WHERE score >= 0.5""",
)
def _(spark, sf):
    names = table(spark, sf, "part").select("p_brand", F.lower("p_name").alias("a")).distinct()
    found = similarity.similar_pairs(names, names.withColumnRenamed("a", "b"), ["p_brand"], "a", "b", 0.5).where("a < b")
    return found.select("p_brand", "a", "b", F.round("similarity", 6).alias("score"))


@query(
    "t04_scored_pairs",
    f"""WITH RECURSIVE pairs AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) || ' ' || lower(p_brand) AS b FROM part), {_RATIO} SELECT p_partkey, round(score, 6) AS score FROM pairs JOIN scores USING (a, b)""",
)
def _(spark, sf):
    """The score of two fields of each record, whatever it is."""
    b = F.concat(F.lower("p_type"), F.lit(" "), F.lower("p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.round(text.fuzzy_score(F.lower("p_name"), b), 6).alias("score"))


#: Forms (even keys) with tables and variables written otherwise than in the records (odd keys).
_FORMS = f"""f AS (SELECT p_partkey AS k, p_partkey // 2 % 6 AS c, p_type AS t, p_name AS v FROM part WHERE p_partkey % 2 = 0),
    p AS (SELECT k AS key, CASE c WHEN 0 THEN lower(t) WHEN 1 THEN t || ' (form)' WHEN 2 THEN t || '-S' WHEN 3 THEN t WHEN 4 THEN 'other' ELSE t || ' x' END AS t, CASE c WHEN 0 THEN upper(v) WHEN 1 THEN replace(v, ' ', '_') WHEN 2 THEN v WHEN 3 THEN v || ' no' WHEN 4 THEN 'none ' || k ELSE v || 'ing' END AS v FROM f),
    r AS (SELECT p_partkey AS record, p_type AS t, p_name AS v FROM part WHERE p_partkey % 2 = 1 AND p_size % 4 > 0),
    pd AS (SELECT *, {_DEEP.format("t")} AS td, {_DEEP.format("v")} AS vd FROM p), rd AS (SELECT *, {_DEEP.format("t")} AS td, {_DEEP.format("v")} AS vd FROM r)"""


def _forms(spark, sf):
    part = table(spark, sf, "part")
    t, v, c = F.col("p_type"), F.col("p_name"), F.floor(F.col("p_partkey") / 2) % 6
    forms = part.where("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("key"),
        F.when(c == 0, F.lower(t)).when(c == 1, F.concat(t, F.lit(" (form)"))).when(c == 2, F.concat(t, F.lit("-S"))).when(c == 3, t).when(c == 4, "other").otherwise(F.concat(t, F.lit(" x"))).alias("t"),
        F.when(c == 0, F.upper(v)).when(c == 1, F.replace(v, F.lit(" "), F.lit("_"))).when(c == 2, v).when(c == 3, F.concat(v, F.lit(" no"))).when(c == 4, F.concat(F.lit("none "), F.col("p_partkey").cast("string"))).otherwise(F.concat(v, F.lit("ing"))).alias("v"),
    )
    records = part.where("p_partkey % 2 = 1 AND p_size % 4 > 0").select(F.col("p_partkey").alias("record"), "p_type", "p_name", F.col("p_type").alias("t"), F.col("p_name").alias("v"))
    return forms, records


def _fuzzy_sql(block: str, compared: str, least: float, base: float, gain: float) -> str:
    return f"""WITH RECURSIVE {_FORMS}, x AS (SELECT DISTINCT {block} AS block, {compared} AS a FROM pd), y AS (SELECT DISTINCT {block} AS block, {compared} AS b FROM rd), pairs AS (SELECT block, a, b FROM x JOIN y USING (block) WHERE a <> '' AND b <> '' AND block <> ''), {_RATIO},
    best AS (SELECT block, a, b, score FROM pairs JOIN scores USING (a, b) WHERE score >= {least} QUALIFY rank() OVER (PARTITION BY block, a ORDER BY score DESC) = 1)
    SELECT key, record, round(score, 6) AS similarity, round({base} + {gain} * score, 4) AS confidence FROM pd JOIN best ON pd.{block} = best.block AND pd.{compared} = best.a JOIN rd ON rd.{block} = best.block AND rd.{compared} = best.b"""


def _fuzzy(spark, sf, block: str, compared: str, least: float, base: float, gain: float):
    forms, records = _forms(spark, sf)
    deep = lambda df, key, name: df.select(key, text.deep_normalise(F.col(block)).alias("block"), text.deep_normalise(F.col(compared)).alias(name)).where("block <> ''")
    found = match.blocked_fuzzy(deep(forms, "key", "a"), deep(records, "record", "b"), "block", "a", "b", least, base, gain)
    return found.select("key", "record", F.round("similarity", 6).alias("similarity"), "confidence")


@query("j04_fuzzy_table", _fuzzy_sql("vd", "td", front.TABLE_LEAST, front.TABLE_BASE, front.TABLE_GAIN))
def _(spark, sf):
    """Equal variable, like table."""
    return _fuzzy(spark, sf, "v", "t", front.TABLE_LEAST, front.TABLE_BASE, front.TABLE_GAIN)


@query("j05_fuzzy_variable", _fuzzy_sql("td", "vd", front.VARIABLE_LEAST, front.VARIABLE_BASE, front.VARIABLE_GAIN))
def _(spark, sf):
    """Equal table, like variable."""
    return _fuzzy(spark, sf, "t", "v", front.VARIABLE_LEAST, front.VARIABLE_BASE, front.VARIABLE_GAIN)


@query(
    "j04_fuzzy_parts",
    f"""WITH RECURSIVE n AS (SELECT DISTINCT p_brand, {_DEEP.format("p_name")} AS t FROM part), pairs AS (SELECT x.p_brand, x.t AS a, y.t AS b FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.t <> y.t), {_RATIO}
    SELECT p_brand, a, b, round(score, 6) AS similarity, round(0.80 + 0.12 * score, 4) AS confidence FROM pairs JOIN scores USING (a, b) WHERE score >= 0.75 QUALIFY rank() OVER (PARTITION BY p_brand, a ORDER BY score DESC) = 1""",
)
def _(spark, sf):
    """All part names with the most alike other name of their brand."""
    names = table(spark, sf, "part").select("p_brand", text.deep_normalise(F.col("p_name")).alias("a")).distinct()
    pairs = match.blocked_fuzzy(names, names.withColumnRenamed("a", "b"), "p_brand", "a", "b", same=False)
    return pairs.select("p_brand", "a", "b", F.round("similarity", 6).alias("similarity"), "confidence")


_COSINE = "round(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(q.vec AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])))), 6)"
#: The random vectors of the table are less alike than real ones.
_VECTOR_LEAST = 0.35
_THRESHOLDS = {"exact": 0.9, "normalised": 0.9, "fuzzy_table": 0.89, "fuzzy_variable": 0.87, "vector": 0.96}

_STRATEGIES = f"""{_FORMS}, low AS (SELECT key, record FROM p JOIN r ON lower(p.t) = lower(r.t) AND lower(p.v) = lower(r.v)),
    deep AS (SELECT key, record FROM pd JOIN rd USING (td, vd) WHERE td <> '' AND vd <> '' AND key NOT IN (SELECT key FROM low)),
    left1 AS (SELECT * FROM pd WHERE key NOT IN (SELECT key FROM low UNION SELECT key FROM deep)),
    pairs AS (SELECT 't' AS kind, vd AS block, l.td AS a, d.td AS b FROM left1 l JOIN rd d USING (vd) WHERE vd <> '' AND l.td <> '' AND d.td <> '' GROUP BY ALL UNION ALL SELECT 'v', td, l.vd, d.vd FROM left1 l JOIN rd d USING (td) WHERE td <> '' AND l.vd <> '' AND d.vd <> '' GROUP BY ALL), {_RATIO},
    best AS (SELECT kind, block, a, b, score FROM pairs JOIN scores USING (a, b) WHERE score >= CASE kind WHEN 't' THEN {front.TABLE_LEAST} ELSE {front.VARIABLE_LEAST} END QUALIFY rank() OVER (PARTITION BY kind, block, a ORDER BY score DESC) = 1),
    ft AS (SELECT key, record, score FROM left1 l JOIN best ON kind = 't' AND l.vd = block AND l.td = a JOIN rd ON rd.vd = block AND rd.td = b),
    fv AS (SELECT key, record, score FROM left1 l JOIN best ON kind = 'v' AND l.td = block AND l.vd = a JOIN rd ON rd.td = block AND rd.vd = b WHERE key NOT IN (SELECT key FROM ft)),
    q AS (SELECT key, embedding AS vec FROM left1 JOIN embeddings ON key = vec_id WHERE key NOT IN (SELECT key FROM ft UNION SELECT key FROM fv)), e AS (SELECT record, embedding AS vec FROM r JOIN embeddings ON record = vec_id),
    ve AS (SELECT key, record, {_COSINE} AS score FROM q, e b WHERE score >= {_VECTOR_LEAST} QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, record) = 1),
    m AS (SELECT key, record, 'exact' AS strategy, 1.0::DOUBLE AS score, 1.0::DOUBLE AS confidence FROM low UNION ALL SELECT key, record, 'normalised', 0.95, 0.95 FROM deep UNION ALL SELECT key, record, 'fuzzy_table', round(score, 4), round({front.TABLE_BASE} + {front.TABLE_GAIN} * score, 4) FROM ft
    UNION ALL SELECT key, record, 'fuzzy_variable', round(score, 4), round({front.VARIABLE_BASE} + {front.VARIABLE_GAIN} * score, 4) FROM fv UNION ALL SELECT key, record, 'vector', round(score, 4), 0.95 FROM ve)"""


def _sides(spark, sf):
    """All forms and all records, with the vectors of those that have one."""
    vectors = table(spark, sf, "embeddings")
    with_vector = lambda df, key: df.join(vectors.select(F.col("vec_id").alias(key), F.col("embedding").alias("vec")), key, "left")
    forms, records = _forms(spark, sf)
    return front.prepared(with_vector(forms, "key"), "key", "t", "v", vec="vec"), front.prepared(with_vector(records, "record"), "record", "t", "v", vec="vec")


@query("j06_full_cascade", f"WITH RECURSIVE {_STRATEGIES} SELECT key, record, strategy, score, confidence FROM m")
def _(spark, sf):
    return front.strategy_matches(*_sides(spark, sf), _VECTOR_LEAST)


@query(
    "m03_query_front",
    f"""WITH RECURSIVE {_STRATEGIES}, s AS (SELECT key, any_value(strategy) AS strategy, max(confidence) AS confidence, count(*) AS n FROM m GROUP BY key),
    d AS (SELECT p.key, strategy, coalesce(confidence, 0.0) AS confidence, n, coalesce(confidence >= CASE strategy {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _THRESHOLDS.items())} END, false) AS direct FROM p LEFT JOIN s USING (key))
    SELECT key, CASE WHEN direct THEN 'direct' ELSE 'reasoning' END AS source, strategy, confidence, CASE WHEN direct THEN n ELSE 0 END AS n FROM d""",
)
def _(spark, sf):
    probe, records = _sides(spark, sf)
    return front.query_front(probe, front.strategy_counts(probe, records, _VECTOR_LEAST), _THRESHOLDS)


@query(
    "t18_closest_names",
    f"""WITH RECURSIVE n AS (SELECT DISTINCT p_brand AS domain, upper(replace(p_name, ' ', '')) || CASE p_partkey % 5 WHEN 0 THEN 'DESC' WHEN 1 THEN 'NUM' WHEN 2 THEN 'X' ELSE '' END AS variable FROM part WHERE p_size % 2 = 0), k AS (SELECT DISTINCT p_brand AS domain, upper(replace(p_name, ' ', '')) AS name FROM part WHERE p_size % 2 = 1),
    bare AS (SELECT *, regexp_replace(variable, '(?:{"|".join(normalise.SUFFIXES)})$', '') AS bare FROM n), pairs AS (SELECT domain, variable, bare, name, variable AS a, name AS b FROM bare JOIN k USING (domain)), {_RATIO},
    s AS (SELECT domain, variable, name, CASE WHEN name = bare THEN 1.0 ELSE ratio END AS ratio FROM pairs JOIN scores USING (a, b))
    SELECT domain, variable, name AS closest, round(ratio, 4) AS ratio FROM s WHERE ratio >= 0.6 QUALIFY row_number() OVER (PARTITION BY domain, variable ORDER BY ratio DESC, name) = 1""",
)
def _(spark, sf):
    plain, tail = F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.col("p_partkey") % 5
    ending = F.when(tail == 0, "DESC").when(tail == 1, "NUM").when(tail == 2, "X").otherwise("")
    part = table(spark, sf, "part")
    rows = part.where("p_size % 2 = 0").select(F.col("p_brand").alias("domain"), F.concat(plain, ending).alias("variable"))
    return normalise.closest_name(rows, part.where("p_size % 2 = 1").select(F.col("p_brand").alias("domain"), plain.alias("variable")))
