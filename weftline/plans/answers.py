"""Queries on answers of models, their checks and their order, keyword lists, and streams that stop and go on."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weftline.functions import mapping, text
from weftline.operators import match, ranking, recommend, spec
from weftline.session import shared_path, table
from weftline.sources import readers
from weftline.streaming import events as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Registers a query (spark, sf_dir) with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# Keyword lists -------------------------------------------------------------------------------------------------------

_WORDS = "SELECT DISTINCT lower(p_name) AS word, p_brand AS label, p_partkey AS seq FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT lower(r_name), 'region', -r_regionkey FROM region UNION ALL SELECT DISTINCT unnest(string_split(p_name, ' ')), 'part', -100 FROM part"


def _words(spark, sf):
    part, region = table(spark, sf, "part"), table(spark, sf, "region")
    whole = part.where("p_partkey % 3 = 0").select(F.lower("p_name").alias("word"), F.col("p_brand").alias("label"), F.col("p_partkey").alias("seq"))
    named = region.select(F.lower("r_name"), F.lit("region"), (-F.col("r_regionkey")).cast("long"))
    return whole.unionAll(named).unionAll(part.select(F.explode(F.split("p_name", " ")), F.lit("part"), F.lit(-100).cast("long")).distinct())


_TEXTS = "SELECT p_partkey, upper(p_name) || ' of ' || p_brand AS t FROM part"


def _texts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat(F.upper("p_name"), F.lit(" of "), "p_brand").alias("t"))


@query("j19_long_list", f"WITH w AS ({_WORDS}), p AS ({_TEXTS}) SELECT p_partkey, word, label FROM p JOIN w ON contains(lower(t), word) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(word) DESC, seq, word) = 1")
def _(spark, sf):
    """A list that grows with the table: still one pass over each text."""
    return match.longest_keyword(_texts(spark, sf), "p_partkey", "t", _words(spark, sf)).select("p_partkey", "word", "label")


@query("t28_ordered_labels", f"WITH w AS ({_WORDS}), p AS ({_TEXTS}), h AS (SELECT p_partkey, label, min(seq) AS seq FROM p JOIN w ON contains(lower(t), word) GROUP BY ALL) SELECT p.p_partkey, coalesce(string_agg(label, ',' ORDER BY seq, label), '') AS labels FROM p LEFT JOIN h USING (p_partkey) GROUP BY p.p_partkey")
def _(spark, sf):
    return match.keyword_outcomes(_texts(spark, sf), "p_partkey", "t", _words(spark, sf)).select("p_partkey", F.array_join("labels", ",").alias("labels"))


_NAMES = {"hot bolt": "HB", "coldring": "CR", "ring": "RG", "large": "LG", "brand#7": "B7"}
_RULES = [("plate", "PL"), ("old", "OD")]
_MEANINGS = [("bl", "BX"), ("blue", "BU")]


@query(
    "t27_table_domains",
    f"""WITH n(name, code, k) AS (VALUES {", ".join(f"('{a}', '{b}', {k})" for k, (a, b) in enumerate(_NAMES.items()))}), p AS (SELECT p_partkey, lower(v) AS low, upper(v) AS high FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' / ' || p_type WHEN 2 THEN p_brand || ' (' || p_type || ')' ELSE p_name || '-' || p_brand END AS v FROM part)),
    t AS (SELECT p_partkey, min((g, pos, code)) AS best FROM (SELECT p_partkey, g, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS token FROM (SELECT p_partkey, s.g AS g, list_transform(string_split(low, s.c), lambda x: trim(x)) AS l FROM p, (VALUES ('/', 1), ('-', 2), ('(', 3), (')', 4)) s(c, g))) JOIN n ON name = token GROUP BY p_partkey)
    SELECT p.p_partkey, coalesce((SELECT code FROM n WHERE name = low), (SELECT code FROM n WHERE name = replace(low, ' ', '')), CASE WHEN contains(low, 'plate') THEN 'PL' WHEN contains(low, 'old') THEN 'OD' END, best[3], CASE WHEN contains(low, 'blue') THEN 'BU' WHEN contains(low, 'bl') THEN 'BX' END,
      CASE WHEN contains(high, 'ECONOMY') THEN 'ECONOMY' END, (SELECT arg_min(code, k) FROM n WHERE contains(low, name))) AS domain FROM p LEFT JOIN t USING (p_partkey)""",
)
def _(spark, sf):
    """Every rule of the waterfall decides some names."""
    kind = F.col("p_partkey") % 4
    named = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat("p_name", F.lit(" / "), "p_type")).when(kind == 2, F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))).otherwise(F.concat("p_name", F.lit("-"), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", mapping.table_domain(named, _NAMES, _RULES, _MEANINGS, ["ECONOMY"]).alias("domain"))


# The grammar of mappings ---------------------------------------------------------------------------------------------


@query(
    "t29_five_kinds",
    """WITH p AS (SELECT p_partkey, p_brand AS b, p_type AS t, p_size % 7 AS k, string_split(p_name, ' ')[1] AS x, string_split(p_name, ' ')[2] AS y FROM part)
    SELECT p_partkey, 1 AS place, upper(b) AS domain, upper(x) AS variable, 'simple' AS kind, CAST(NULL AS VARCHAR) AS condition, CAST(NULL AS VARCHAR) AS qnam FROM p WHERE k = 0
    UNION ALL SELECT p_partkey, 2, t, 'QVAL', 'supp', 'when QNAM=' || y, upper(y) FROM p WHERE k = 0
    UNION ALL SELECT p_partkey, i, upper(b), CASE i WHEN 1 THEN upper(x) ELSE upper(y) END, 'conditional', 'WHEN VSTESTCD="a/b | c when d"', NULL FROM p, range(1, 3) r(i) WHERE k = 1
    UNION ALL SELECT p_partkey, 1, upper(b), upper(x), 'assignment', y, NULL FROM p WHERE k = 2 UNION ALL SELECT p_partkey, 2, upper(b), upper(y), 'assignment', x || ' when Z=1', NULL FROM p WHERE k = 2
    UNION ALL SELECT p_partkey, 1, upper(b), upper(x), 'conditional_other', 'if ' || y || '>0', NULL FROM p WHERE k = 3 UNION ALL SELECT p_partkey, 2, upper(b), upper(y), 'simple', NULL, NULL FROM p WHERE k = 3
    UNION ALL SELECT p_partkey, 1, upper(b), upper(x) || ' WHEN', 'simple', NULL, NULL FROM p WHERE k = 4""",
)
def _(spark, sf):
    """Expressions of all kinds: pairs of domains, shared conditions with quoted slashes and bars, assignments, conditions of one part only, an open condition, and blank ones."""
    x, y, k, lit = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_size") % 7, F.lit
    domain = F.when(k == 0, F.concat("p_brand", lit(" | "), "p_type")).when(k == 5, "").otherwise(F.concat(lit(" "), F.lower("p_brand")))
    said = (
        F.when(k == 0, F.concat(x, lit(" |QVAL  when  QNAM = "), y)).when(k == 1, F.concat(x, lit(" / "), y, lit(' WHEN VSTESTCD = "a/b | c when d"'))).when(k == 2, F.concat(x, lit("="), y, lit("/"), y, lit(" = "), x, lit(" when Z=1")))
        .when(k == 3, F.concat(x, lit(" if "), y, lit(">0/"), y)).when(k == 4, F.concat(x, lit(" when "))).when(k == 5, x)
    )
    parsed = table(spark, sf, "part").select("p_partkey", F.posexplode(spec.grammar(domain, said)).alias("place", "m"))
    return parsed.select("p_partkey", (F.col("place") + 1).alias("place"), "m.*")


# Answers in order, and from models -----------------------------------------------------------------------------------


def _turn(row: dict, earlier: list[str]) -> str:
    """A stand-in for a model whose answer hangs on those before it."""
    return f"{(len(row['role']) + int(row['turn']) + sum(map(int, earlier))) % 97}"


@query(
    "w20_feedback",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations),
    f AS (SELECT conv_id, turn, n, [CASE WHEN turn % 7 = 3 THEN 5 ELSE CAST((length(role) + turn) % 97 AS BIGINT) END] AS said FROM c WHERE n = 1
      UNION ALL SELECT c.conv_id, c.turn, c.n, list_append(said[-14:], CASE WHEN c.turn % 7 = 3 THEN 5 ELSE CAST((length(c.role) + c.turn + list_sum(said[-15:])) % 97 AS BIGINT) END) FROM f JOIN c ON c.conv_id = f.conv_id AND c.n = f.n + 1)
    SELECT conv_id, turn, CAST(said[-1] AS VARCHAR) AS answer FROM f""",
)
def _(spark, sf):
    """Each turn is answered with the fifteen answers before it; some are given already."""
    rows = table(spark, sf, "conversations").withColumn("given", F.when(F.col("turn") % 7 == 3, "5"))
    return ranking.folded(rows, ["conv_id"], ["turn", "role", "text"], ["role"], _turn, 15, "given").select("conv_id", "turn", "answer")


def _counts(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query("v05_stored_embeddings", "SELECT t AS text, length(t)::DOUBLE AS a, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS b FROM (SELECT p_name AS t FROM part UNION SELECT p_brand || ' ' || p_name FROM part)")
def _(spark, sf):
    """A second run over more texts embeds only those that the first has not stored."""
    store = f"{shared_path(spark, 'vectors')}/store"
    part = table(spark, sf, "part")
    names = part.select(F.col("p_name").alias("t"))
    recommend.embedded(names, "t", store, _counts).write.format("noop").mode("overwrite").save()
    found = recommend.embedded(names.unionAll(part.select(F.concat_ws(" ", "p_brand", "p_name"))), "t", store, _counts)
    return found.select("text", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))


def _model(prompt: str, n: int) -> str:
    """A stand-in for a model: good JSON in fences, JSON at the second try, never, no target, or a failure."""
    kind, name = prompt.split("|", 1)
    if kind == "0" or kind == "1" and n == 1:
        return f"Sure {{ok}}:\n```json\n{json.dumps({'domain': ' ' + name[:2].lower(), 'sdtm_variable': name.upper().replace(' ', ''), 'score': 0.5 + 0.25 * n})}\n```"
    if kind == "4":
        raise TimeoutError(name)
    return '{"domain": "X"}' if kind == "3" else '{"domain": "X", "sdtm_variable": '


def _answers(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select("p_partkey", F.concat((F.col("p_size") % 5).cast("string"), F.lit("|"), "p_name").alias("prompt"), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("d"), (F.col("p_size") % 3).cast("string"))).alias("own"))
    return recommend.infer_targets(rows, "p_partkey", "prompt", "p_name", "own", _model)


_ANSWERS = """a AS (SELECT p_partkey, p_size % 5 AS kind, upper(p_name) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'D' || p_size % 3 ELSE 'UNMAPPED' END AS own FROM part),
    m AS (SELECT p_partkey, CASE WHEN kind < 2 THEN left(name, 2) ELSE own END AS domain, CASE WHEN kind < 2 THEN replace(name, ' ', '') ELSE own || '_' || name || '_PENDING' END AS variable, CASE kind WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 ELSE 0.0 END::DOUBLE AS score,
      CASE WHEN kind < 2 THEN 'LLM' ELSE 'FALLBACK' END AS source, CASE WHEN kind = 0 THEN 1 ELSE 2 END AS tries, CASE kind WHEN 2 THEN 'no JSON' WHEN 3 THEN 'no target' WHEN 4 THEN 'TimeoutError' END AS reason FROM a)"""


@query("m04_inferred_targets", f"WITH {_ANSWERS} SELECT p_partkey, domain, variable, score, source, tries, reason FROM m")
def _(spark, sf):
    return _answers(spark, sf)


@query(
    "m05_checked_answers",
    f"""WITH {_ANSWERS}, b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY score DESC, p_partkey) = 1 AS top FROM m), k AS (SELECT DISTINCT upper(left(p_name, 2)) AS domain, upper(replace(p_name, ' ', '')) || CASE WHEN p_size % 2 = 0 THEN 'X' ELSE '' END AS variable FROM part WHERE p_size % 5 = 0 AND p_name NOT LIKE 'red%'),
    l AS (SELECT domain, list(variable) AS names FROM k GROUP BY domain), c AS (SELECT b.*, names, list_contains(names, variable) AS there, length(variable) > 8 AS long, starts_with(variable, b.domain) AS pre, regexp_full_match(variable, '[A-Z0-9_]+') AS caps FROM b LEFT JOIN l USING (domain)),
    s AS (SELECT c.p_partkey, string_agg(n, ',' ORDER BY length(n), n) AS near FROM (SELECT p_partkey, n FROM (SELECT p_partkey, variable, unnest(names) AS n FROM c WHERE top AND NOT there) WHERE contains(n, variable) OR contains(variable, n) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(n), n) <= 3) c GROUP BY 1)
    SELECT c.p_partkey, CASE WHEN top THEN coalesce(there, false) END AS validated, CASE WHEN top THEN round(CASE WHEN names IS NULL THEN 0.0 ELSE 0.3 END + CASE WHEN there THEN 0.5 ELSE 0.0 END + 0.2 * CASE WHEN long THEN 0.0 ELSE round(0.3 + CASE WHEN pre THEN 0.4 ELSE 0.0 END + CASE WHEN caps THEN 0.3 ELSE 0.0 END, 4) END, 4)::DOUBLE END AS validity,
      CASE WHEN top THEN CASE WHEN names IS NULL THEN 'domain ' || domain || ' not found' WHEN NOT there THEN 'variable ' || variable || ' not found in ' || domain ELSE '' END END AS issues, CASE WHEN top THEN coalesce(near, '') END AS suggestions FROM c LEFT JOIN s USING (p_partkey)""",
)
def _(spark, sf):
    """The best of every three answers against a catalogue that lacks some domains and some names."""
    part = table(spark, sf, "part").where("p_size % 5 = 0 AND p_name NOT LIKE 'red%'")
    named = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.when(F.col("p_size") % 2 == 0, "X").otherwise(""))
    catalogue = part.select(F.upper(F.substring("p_name", 1, 2)).alias("domain"), named.alias("variable")).distinct()
    rows = _answers(spark, sf).select(F.floor(F.col("p_partkey") / 3).alias("key"), "p_partkey", "domain", "variable", "score")
    found = recommend.checked_top(rows, catalogue, "key", "score", "p_partkey")
    return found.select("p_partkey", "validated", "validity", F.array_join("issues", ",").alias("issues"), F.array_join("suggestions", ",").alias("suggestions"))


_CATEGORIES = ["LARGE", "SMALL", "ECONOMY"]


@query(
    "t43_variable_listing",
    """WITH h AS (SELECT DISTINCT o_custkey AS key, 'Brand#' || o_orderkey % 27 AS domain FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT key, count(*) AS n FROM h GROUP BY key), d AS (SELECT c_custkey AS key, 'Brand#' || k AS domain FROM customer, range(1, 4) r(k) WHERE c_custkey NOT IN (SELECT key FROM h)),
    a AS (SELECT key, domain, n, row_number() OVER (PARTITION BY key ORDER BY CAST(replace(domain, 'Brand#', '') AS INTEGER)) AS r FROM (SELECT key, domain FROM h UNION ALL SELECT * FROM d) LEFT JOIN n USING (key)),
    l AS (SELECT p_brand AS domain, min(p_type) AS category, list(p_name || ' ' || p_partkey ORDER BY p_partkey) AS names FROM part GROUP BY p_brand),
    x AS (SELECT key, category, domain, r, CASE WHEN n <= 2 THEN len(names) ELSE 8 END AS most, names FROM a JOIN l USING (domain) WHERE r <= 6)
    SELECT key, category, domain, CAST(row_number() OVER (PARTITION BY key ORDER BY CASE category WHEN 'LARGE' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'ECONOMY' THEN 3 ELSE 4 END, r) AS INTEGER) AS place, md5('- ' || domain || ' (' || lower(domain) || '): ' || array_to_string(names[1:most], ', ') || CASE WHEN len(names) > most THEN ', ... (+' || len(names) - most || ' more)' ELSE '' END) AS line FROM x""",
)
def _(spark, sf):
    """The brands that a customer's orders hint at, with their parts; customers without a hint get the usual ones."""
    part = table(spark, sf, "part")
    brands = part.groupBy("p_brand").agg(F.min("p_type").alias("category"))
    catalogue = part.join(brands, "p_brand").select(F.col("p_brand").alias("domain"), F.lower("p_brand").alias("name"), "category", F.concat_ws(" ", "p_name", "p_partkey").alias("variable"), F.col("p_partkey").alias("place"))
    hinted = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 27).alias("place")).distinct()
    hints = hinted.select("key", F.concat(F.lit("Brand#"), F.col("place").cast("string")).alias("domain"), "place")
    none = table(spark, sf, "customer").select(F.col("c_custkey").alias("key")).join(hinted.select("key").distinct(), "key", "left_anti")
    hints = hints.unionByName(none.select("key", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("long").alias("place")))
    return recommend.variable_listing(hints, catalogue, _CATEGORIES, ["Brand#1", "Brand#2", "Brand#3"], lambda line: F.md5(line.cast("binary")))


# Outputs and cases ---------------------------------------------------------------------------------------------------


@query(
    "s14_originals",
    """WITH f AS (SELECT o_custkey, o_orderpriority AS name, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL) SELECT o.o_custkey, o.o_orderkey, f.first AS original_key, f.first IS NOT NULL AS matched FROM orders o LEFT JOIN f ON o.o_custkey = f.o_custkey AND o.o_orderpriority = f.name""",
)
def _(spark, sf):
    """Nested outputs of each customer with the first original of the same name, where there is one."""
    orders = table(spark, sf, "orders")
    recommendation = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("variable_name"))))
    original = F.array_sort(F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("metadata_variable")))))
    nested = orders.groupBy("o_custkey").agg(recommendation.alias("recommendations"), original.alias("originals"))
    return readers.nested_outputs(nested, originals="originals").select("o_custkey", "o_orderkey", "original_key", "matched")


@query(
    "t49_cases",
    """WITH v AS (SELECT p_brand, p_name, p_type, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part), r AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'Topic' WHEN 1 THEN 'Timing' END AS role FROM v WHERE n < 4)
    SELECT p_brand || '_' || n || '_direct' AS id, 'Map ''' || p_type || ''' to SDTM variable' AS query, p_name AS expected_variable, 'Domain: ' || p_brand || ', Role: ' || coalesce(role, 'Unknown') AS context FROM r WHERE 2 * n < 7
    UNION ALL SELECT p_brand || '_' || n || '_functional', CASE role WHEN 'Topic' THEN 'Map the main topic field for ' WHEN 'Timing' THEN 'Map timing information for ' ELSE 'Map field for ' END || lower(p_type), p_name, 'Domain: ' || p_brand || ', Type: ' || p_size FROM r WHERE 2 * n + 1 < 7""",
)
def _(spark, sf):
    size = F.col("p_size") % 3
    variables = table(spark, sf, "part").withColumn("role", F.when(size == 0, "Topic").when(size == 1, "Timing")).withColumn("kind", F.col("p_size").cast("string"))
    return text.evaluation_cases(variables, "p_brand", "p_partkey", "p_name", "p_type", "role", "kind", 7).select("id", "query", "expected_variable", "context")


# Streams that stop and go on -----------------------------------------------------------------------------------------

_LATEST = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def _in_files(spark, sf, path: str, which: int) -> None:
    """A third of the events, newest thirds first, added to the folder of a stream."""
    rows = table(spark, sf, "events").where(F.col("event_id") % 3 == 2 - which)
    rows.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(path)


@query("r02_stream_upsert", _LATEST)
def _(spark, sf):
    """Files out of order, in three runs of one stream: each goes on from the checkpoint of the one before, and the target is the batch's latest rows."""
    path = shared_path(spark, "upsert")
    for which in range(3):
        _in_files(spark, sf, f"{path}/in", which)
        stream = spark.readStream.schema("user_id bigint, event_id bigint, event_type string, ts timestamp").parquet(f"{path}/in")
        streams.upsert_stream(stream, f"{path}/target", f"{path}/checkpoint", ["user_id"], "ts", "event_id")
    return streams.newest_version(spark, f"{path}/target").select("user_id", "event_id", "event_type")


@query("r03_stream_resume", "SELECT event_id, user_id % 5 AS part FROM events")
def _(spark, sf):
    """A stream into files that is stopped and run again: every event once, none twice."""
    path = shared_path(spark, "resume")
    for which in range(3):
        _in_files(spark, sf, f"{path}/in", which)
        stream = spark.readStream.schema("user_id bigint, event_id bigint, event_type string, ts timestamp").parquet(f"{path}/in")
        found = streams.run_to_files(stream.select("event_id", (F.col("user_id") % 5).alias("part")), f"{path}/out", f"{path}/checkpoint")
    return found
