"""Queries on text, vectors, the cascade, scores, gates and streams, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import cascade, evaluate, normalise, profile, ranking, spec, vector
from weftline.session import shared_path, table
from weftline.streaming import events as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir), with the SQL that gives the same rows if there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Scalars -------------------------------------------------------------------------------------------------------------


@query("t01_normalise", f"SELECT doc_id, md5(lower(trim(coalesce(text, ''), '{text.WHITE}'))) AS key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("key"))


@query(
    "t02_deep_normalise",
    "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(v)), '[(][^)]*[)]', '', 'g'), '[/\\\\]', '', 'g'), '[\\s_\\-.,;:]+', '', 'g') AS key FROM (SELECT p_partkey, p_name || ' (' || p_brand || ') / ' || p_type AS v FROM part)",
)
def _(spark, sf):
    v = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") / "), "p_type")
    return table(spark, sf, "part").select("p_partkey", text.deep_normalise(v).alias("key"))


@query("t03_composite_key", "SELECT p_partkey, lower(trim(p_name)) || '|||' || lower(trim(p_brand)) || '|||' || lower(trim(p_type)) AS key FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.composite_key(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("key"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("t05_key_terms", f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})), ' ') AS terms FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.key_terms(F.col("text")), " ").alias("terms"))


@query(
    "t06_name_score",
    """SELECT p_partkey, CASE WHEN length(w) > 8 OR w = '' THEN 0.0 ELSE CAST(round(0.3 + CASE WHEN starts_with(w, 'B') THEN 0.4 ELSE 0.0 END + CASE WHEN regexp_full_match(w, '[A-Z0-9_]+') THEN 0.3 ELSE 0.0 END, 4) AS DOUBLE) END AS score FROM (SELECT p_partkey, replace(p_brand, '#', '') AS w FROM part)""",
)
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.naming_score(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("B")).alias("score"))


@query("t09_split_condition", "SELECT o_orderkey, trim(regexp_split_to_array(v, ' when ')[1]) AS variable, trim(regexp_split_to_array(v, ' when ')[2]) AS condition, o_orderstatus AS value FROM (SELECT o_orderkey, o_orderstatus, 'V' || o_custkey || ' when STATUS = \"' || o_orderstatus || '\"' AS v FROM orders)")
def _(spark, sf):
    v = F.concat(F.lit("V"), F.col("o_custkey").cast("string"), F.lit(' when STATUS = "'), "o_orderstatus", F.lit('"'))
    return table(spark, sf, "orders").select("o_orderkey", text.split_condition(v).alias("s")).select("o_orderkey", "s.variable", "s.condition", "s.value")


@query(
    "t10_multi_split",
    """WITH s AS (SELECT p_partkey, string_split(upper(p_type), ' ') AS d, string_split(p_name, ' ') AS v FROM part), h AS (SELECT *, list_filter(d, lambda x: x IN ('STEEL', 'BRASS', 'POLISHED'))[1] AS hit FROM s)
    SELECT p_partkey, hit AS domain, CASE WHEN hit IS NOT NULL THEN trim(v[least(list_position(d, hit), len(v))]) END AS variable FROM h""",
)
def _(spark, sf):
    s = text.first_valid(F.replace("p_type", F.lit(" "), F.lit("|")), F.replace("p_name", F.lit(" "), F.lit("|")), ["STEEL", "BRASS", "POLISHED"])
    return table(spark, sf, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.domain", "s.variable")


@query(
    "t12_stable_token",
    """WITH t AS (SELECT p_partkey, upper(trim(p_size || p_name)) AS x FROM part), u AS (SELECT *, 'Q' || regexp_replace(x, '[^A-Z0-9]', '', 'g') AS n FROM t)
    SELECT p_partkey, CASE WHEN length(n) <= 8 THEN n ELSE left(n, 4) || left(upper(sha256(x)), 4) END AS token FROM u""",
)
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.stable_token(F.concat(F.col("p_size").cast("string"), "p_name")).alias("token"))


@query(
    "t20_diff_status",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'ai_only' WHEN o_totalprice < 50000 THEN 'ref_only' WHEN o_orderstatus <> CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END THEN 'domain_diff' WHEN left(o_orderpriority, 1) <> CAST(o_orderkey % 5 AS VARCHAR) THEN 'var_diff' ELSE 'match' END AS status FROM orders""",
)
def _(spark, sf):
    own = F.when(F.col("o_totalprice") < 50000, "").otherwise(F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O"))
    ref = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", text.diff_status(own, (F.col("o_orderkey") % 5).cast("string"), ref, F.substring("o_orderpriority", 1, 1)).alias("status"))


@query("t24_labels", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(p_type, 'BRASS') THEN 'brass' END, CASE WHEN regexp_matches(p_type, '^STANDARD') THEN 'standard' END, CASE WHEN regexp_matches(p_type, '[AEIOU]{2}') THEN 'vowels' END], lambda x: x IS NOT NULL), ',') AS labels FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.labels(F.col("p_type"), [("brass", "BRASS"), ("standard", "^STANDARD"), ("vowels", "[AEIOU]{2}")]), ",").alias("labels"))


@query("t29_grammar_explode", "WITH m AS (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) SELECT p_partkey, upper(p_brand) AS domain, upper(trim(w)) AS variable, 'conditional' AS kind, 'X = 1' AS condition FROM m")
def _(spark, sf):
    variables = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.lit(" when X = 1"))), "|")
    parsed = table(spark, sf, "part").select("p_partkey", F.inline(spec.parse_mappings(F.col("p_brand"), variables)))
    return parsed.select("p_partkey", "domain", "variable", "kind", "condition")


_RULES = [(1, "exact", "ECONOMY BRASS", "first"), (2, "pattern", "BRASS$", "brass"), (3, "pattern", "^(PROMO|ECONOMY)", "offer"), (4, "pattern", ".", "rest")]


@query("t32_first_rule", f"WITH r(seq, kind, test, outcome) AS (VALUES {', '.join(map(str, _RULES))}) SELECT p_partkey, outcome FROM part JOIN r ON CASE WHEN kind = 'exact' THEN p_type = test ELSE regexp_matches(p_type, test) END QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY seq) = 1")
def _(spark, sf):
    rules = spark.createDataFrame(_RULES, "seq int, kind string, test string, outcome string")
    return spec.first_rule(table(spark, sf, "part"), "p_partkey", "p_type", rules).select("p_partkey", "outcome")


@query("t34_weighted_length", "SELECT doc_id, CAST(length(text) + 2 * len(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿　-〿＀-￯]')) AS BIGINT) AS weight FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.weighted_length(F.col("text")).cast("long").alias("weight"))


_MASKED = "text"
for _pattern in text.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', '{text.MARKER}', 'g')"


@query("t35_mask", f"SELECT doc_id, md5({_MASKED}) AS masked FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.mask(F.col("text"))).alias("masked"))


@query("t37_fingerprint", "SELECT p_partkey, sha256('[\"' || lower(trim(p_name)) || '\",\"' || lower(trim(p_brand)) || '\"]') AS fingerprint FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.fingerprint(F.col("p_name"), F.col("p_brand")).alias("fingerprint"))


@query("t40_chunks", "SELECT p_partkey, left('Name: ' || p_name || '\nBrand: ' || p_brand || '\nType: ' || p_type, 40) AS chunk FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.chunk([("Name", F.col("p_name")), ("Brand", F.col("p_brand")), ("Type", F.col("p_type"))], most=40).alias("chunk"))


@query("t42_char_budget", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used FROM conversations QUALIFY sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= 1500")
def _(spark, sf):
    return ranking.within_budget(table(spark, sf, "conversations"), ["conv_id"], "turn", F.length("text"), 1500).select("conv_id", "turn", "used")


@query("t44_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", text.json_field(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "$.k").cast("long").alias("k"))


@query("t48_bands", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.9 THEN 'high' WHEN l_discount * 10 >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.band(F.col("l_discount") * 10).alias("band"))


@query("t51_catalogue", "SELECT p_brand, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names, count(DISTINCT p_name) AS n FROM part GROUP BY p_brand")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("names"), F.count_distinct("p_name").alias("n"))


@query("t14_normalised_recommendations")
def _(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select(F.col("p_size").alias("key"), F.col("p_partkey").alias("seq"), F.upper(F.replace("p_type", F.lit(" "), F.lit("|"))).alias("domain"), F.concat_ws("|", F.col("p_name")).alias("variable"), (F.col("p_retailprice") / 3000).alias("score"))
    names = part.select(F.explode(F.split(F.upper("p_type"), " ")).alias("domain"), F.upper(F.substring("p_name", 1, 8)).alias("variable"))
    return normalise.normalise(rows, names, ["BRASS", "STEEL", "COPPER"]).select("key", "seq", "domain", "variable", "kind", "qnam", "score", "check")


# Vectors and the cascade ---------------------------------------------------------------------------------------------

_COSINE = "round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6)"
_HITS = f"WITH s AS (SELECT q.vec_id AS qid, b.vec_id AS id, q.label AS qlabel, b.label AS label, {_COSINE} AS score FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0), h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5)"


def _hits(spark, sf, k=5, least=-2.0):
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel"))
    base = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return vector.top_similar(queries, base, k, least)


@query("v01_topk_cosine", f"{_HITS} SELECT qid, id, score FROM h")
def _(spark, sf):
    return _hits(spark, sf).select("qid", "id", "score")


@query("v02_threshold_topk", f"{_HITS} SELECT qid, id, score FROM h WHERE score >= 0.3 AND rank = 1")
def _(spark, sf):
    return _hits(spark, sf, 1, 0.3).select("qid", "id", "score")


@query("v03_weighted_rescore", f"{_HITS} SELECT qid, id, round(score * CASE WHEN label > 0 THEN label ELSE 1.0 END, 6) AS score FROM h")
def _(spark, sf):
    return vector.rescore(_hits(spark, sf).withColumn("w", F.col("label").cast("double")), "w").select("qid", "id", "score")


@query("v04_mismatch_penalty", f"{_HITS}, p AS (SELECT qid, id, label, round(CASE WHEN label = qlabel THEN score ELSE score * 0.5 END, 6) AS score FROM h) SELECT qid, id, label, score FROM p QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) = 1")
def _(spark, sf):
    return vector.penalise(_hits(spark, sf), F.col("label") == F.col("qlabel"), ["label"]).select("qid", "id", F.col("label"), "score")


@query("v07_partition_by_source", "SELECT label % 2 = 0 AS fixed, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "embeddings").groupBy((F.col("label") % 2 == 0).alias("fixed")).agg(F.count("*").alias("n"))


@query(
    "m01_cascade_case",
    """WITH b AS (SELECT l_orderkey, max(l_discount * 9) AS kb, max(l_tax * 10) AS rag, bool_or(l_quantity = 50) AS exact FROM lineitem GROUP BY 1), c AS (SELECT *, CASE WHEN kb >= 0.8 AND (exact OR kb >= 0.85) THEN 1 WHEN kb >= 0.8 THEN 2 WHEN rag >= 0.7 THEN 3 ELSE 4 END AS level FROM b)
    SELECT level, CASE WHEN level <= 2 THEN 'KB' WHEN level = 3 THEN 'RAG' ELSE 'LLM' END AS source, count(*) AS n FROM c GROUP BY ALL""",
)
def _(spark, sf):
    by = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_discount") * 9).alias("kb"), F.max(F.col("l_tax") * 10).alias("rag"), F.bool_or(F.col("l_quantity") == 50).alias("exact"))
    level = cascade.level(F.col("kb"), F.col("exact"), F.col("rag"))
    return by.select(level.alias("level")).groupBy("level", cascade.source(F.col("level")).alias("source")).agg(F.count("*").alias("n"))


@query("a41_confidence", "SELECT l_orderkey, round(least(1.0, max(l_discount * 9) + CASE WHEN coalesce(list_sort(list(l_discount * 9), 'DESC')[2], 0) > 0.3 THEN 0.1 ELSE 0.0 END), 6) AS confidence FROM lineitem GROUP BY 1")
def _(spark, sf):
    by = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") * 9).alias("s"))
    return by.select("l_orderkey", F.round(profile.confidence(F.col("s")), 6).alias("confidence"))


# Scores and gates ----------------------------------------------------------------------------------------------------


@query(
    "j14_full_outer_score",
    """WITH p AS (SELECT doc_id, CASE WHEN n_chars > 800 THEN 'Q1' ELSE 'Q0' END AS ai FROM documents WHERE doc_id % 3 <> 0) SELECT coalesce(l.doc_id, p.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'extra' WHEN p.doc_id IS NULL THEN 'missing' WHEN ai <> 'Q' || quality THEN 'domain_diff' ELSE 'match' END AS status FROM labels l FULL JOIN p ON l.doc_id = p.doc_id""",
)
def _(spark, sf):
    truth = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("domain"), F.lit("x").alias("variable"))
    said = table(spark, sf, "documents").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") > 800, "Q1").otherwise("Q0").alias("ai_domain"), F.lit("x").alias("ai_variable"))
    return evaluate.score(truth, said, "doc_id").select("doc_id", "status")


@query(
    "a19_grouping_sets",
    """SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'all' END AS slice_kind, coalesce(l_returnflag, l_linestatus, 'all') AS slice, count(*) AS total, CAST(count(*) FILTER (l_discount > 0.05) AS BIGINT) AS matched, round(count(*) FILTER (l_discount > 0.05) / count(*), 4) AS rate
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""",
)
def _(spark, sf):
    return evaluate.sliced(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") > 0.05)


_PRF = """WITH j AS (SELECT quality = 1 AS t, n_chars > 800 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM j)
    SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) ELSE 0.0 END AS f1 FROM c"""


@query("a20_precision_recall", _PRF)
def _(spark, sf):
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.precision_recall(both, F.col("quality") == 1, F.col("n_chars") > 800)


@query(
    "a21_set_scores",
    """WITH t AS (SELECT DISTINCT o_custkey AS g, o_orderpriority AS k FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT DISTINCT o_custkey AS g, o_orderpriority AS k FROM orders WHERE o_orderstatus <> 'F') SELECT coalesce(t.g, f.g) AS g, count(t.k) AS n_truth, count(f.k) AS n_found, count(*) FILTER (t.k IS NOT NULL AND f.k IS NOT NULL) AS n_shared FROM t FULL JOIN f ON t.g = f.g AND t.k = f.k GROUP BY 1""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("k"), "o_orderstatus")
    return evaluate.set_scores(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), "g", "k")


def _pairs(spark, sf):
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select("doc_id", (F.col("quality") == (F.col("n_chars") > 800).cast("int")).alias("a"), (F.col("quality") == (F.col("n_chars") > 500).cast("int")).alias("b"))


@query(
    "b01_paired_counts",
    """WITH j AS (SELECT CAST(quality = CAST(n_chars > 500 AS INT) AS INT) - CAST(quality = CAST(n_chars > 800 AS INT) AS INT) AS d FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS n, round(avg(d), 6) AS delta, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse FROM j""",
)
def _(spark, sf):
    return evaluate.bootstrap(_pairs(spark, sf), "doc_id", F.col("a"), F.col("b"), rounds=1).select("n", "delta", "better", "worse")


@query("b01_bootstrap")
def _(spark, sf):
    return evaluate.bootstrap(_pairs(spark, sf), "doc_id", F.col("a"), F.col("b"))


@query(
    "b02_gates",
    """WITH m AS (SELECT count(*) AS n, avg(l_discount) AS d, count(*) FILTER (l_returnflag = 'R') / count(*) AS r FROM lineitem), g AS (SELECT unnest(['coverage', 'discount', 'returned']) AS gate, unnest([n > 0, d >= 0.04, r < 0.2]) AS passed FROM m) SELECT gate, passed, CASE WHEN (SELECT bool_and(passed) FROM g) THEN 'ACCEPT' ELSE 'ROLLBACK' END AS verdict FROM g""",
)
def _(spark, sf):
    metrics = table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.avg("l_discount").alias("d"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("r"))
    return evaluate.gates(metrics, [("coverage", F.col("n") > 0), ("discount", F.col("d") >= 0.04), ("returned", F.col("r") < 0.2)])


@query(
    "b03_tolerance",
    """WITH x AS (SELECT o_orderpriority AS metric, count(*) FILTER (o_orderkey % 2 = 0) AS base, count(*) FILTER (o_orderkey % 2 = 1) AS now FROM orders GROUP BY 1) SELECT metric, base, now, now >= base - 5 AS passed FROM x""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    half = lambda k: orders.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("value"))
    return evaluate.tolerance(half(1), half(0), 5)


# Streams -------------------------------------------------------------------------------------------------------------


@query("r01_stream_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    found = streams.summary(table(spark, sf, "events"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "r01_stream_run",
    """SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
    WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""",
)
def _(spark, sf):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    stream = streams.summary(streams.read_events(spark, sf, schema, "events.parquet"))
    found = streams.run_to_files(stream, shared_path(spark, "summary"), shared_path(spark, "summary-checkpoint"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r02_latest_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, sf):
    return ranking.latest(table(spark, sf, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("r03_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)")
def _(spark, sf):
    done = table(spark, sf, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return streams.resume(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("s04_metadata_fields", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'")
def _(spark, sf):
    from weftline.sources.readers import with_metadata

    found = with_metadata(table(spark, sf, "events").where("event_type = 'click'"), {"k": "$.k"}, "props")
    return found.select("event_id", "event_type", F.col("k").cast("long").alias("k"))


@query("s15_duplicate_truth", "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    from weftline.sources.readers import duplicate_keys

    return duplicate_keys(table(spark, sf, "part"), ["p_name", "p_brand"])


@query("k06_nested", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def _(spark, sf):
    from weftline.sources.sinks import nested

    found = nested(table(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])
    return found.select("o_custkey", F.array_join(F.transform("recommendations", lambda r: r["o_orderkey"].cast("string")), ",").alias("orders"))


@query("w17_examples_same_group_first", "SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type LIKE 'STANDARD%' THEN 0 ELSE 1 END, p_partkey) <= 5")
def _(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.when(F.col("p_type").startswith("STANDARD"), 0).otherwise(1), "p_partkey")
    return table(spark, sf, "part").withColumn("r", F.row_number().over(w)).where("r <= 5").select("p_partkey", "p_brand")
