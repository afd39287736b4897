"""Queries on mapping expressions, suggestions and specification tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import mapping
from weftline.operators import evaluate, recommend, sheets
from weftline.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("f07_base_domain", "SELECT p_partkey, regexp_replace(upper(trim('supp' || p_brand)), '^SUPP', '') AS domain FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", mapping.base_domain(F.concat(F.lit("supp"), "p_brand")).alias("domain"))


@query("f08_name_shape", "SELECT n_nationkey, regexp_full_match(left(n_name, 2) || 'CODE', '[A-Z]{2}(DESC|CODE)') AS shaped FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", mapping.standard_shape(F.concat(F.substring("n_name", 1, 2), F.lit("CODE")), ("DESC", "CODE")).alias("shaped"))


@query("f09_holds_any", "SELECT p_partkey, contains(lower(p_type), 'brass') OR contains(lower(p_type), 'tin') AS hit FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", mapping.holds_any(F.col("p_type"), ("BRASS", "tin")).alias("hit"))


@query("f18_complete_rows", "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND quality IN (0, 1)")
def _(spark, sf):
    return table(spark, sf, "labels").where("quality is not null and toxic is not null and quality in (0, 1)").select("doc_id", "quality")


@query("f19_drop_empty_rows", "SELECT o_orderkey, low, high FROM (SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN o_totalprice END AS low, CASE WHEN o_totalprice > 300000 THEN o_totalprice END AS high FROM orders) WHERE low IS NOT NULL OR high IS NOT NULL")
def _(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.when(price < 50000, price).alias("low"), F.when(price > 300000, price).alias("high")).na.drop("all", subset=["low", "high"])


@query("f20_rejected_qualifiers", "SELECT p_partkey, upper(p_brand || p_name) AS qnam FROM part WHERE upper(p_brand || p_name) NOT IN (SELECT upper(p_brand || p_name) FROM part WHERE p_size > 40)")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.upper(F.concat("p_brand", "p_name")).alias("qnam"), "p_size")
    return recommend.rejected_qualifiers(part, part.where("p_size > 40").select(F.col("qnam").alias("variable"))).select("p_partkey", "qnam")


@query("t07_suggestions", "SELECT p_partkey, round(CASE WHEN contains(lower(p_name), 'a') THEN 0.4 ELSE 0.0 END + CASE WHEN contains(lower(p_type), 'a') THEN 0.3 ELSE 0.0 END + CASE WHEN contains('brand#11 brand#23', lower(p_brand)) THEN 0.2 ELSE 0.0 END + CASE WHEN p_size > 25 THEN 0.1 ELSE 0.0 END, 4)::DOUBLE AS score FROM part")
def _(spark, sf):
    score = recommend.suggestion_score(F.lit("A"), F.lit("Brand#11 Brand#23"), F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.when(F.col("p_size") > 25, "Req"))
    return table(spark, sf, "part").select("p_partkey", score.alias("score"))


@query(
    "t08_validation",
    """WITH r AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'P' ELSE 'Z' END AS domain, upper(left(p_name, 9)) AS variable FROM part), c AS (SELECT DISTINCT 'P' AS domain, upper(left(p_name, 9)) AS variable FROM part WHERE p_size > 25)
    SELECT r.domain, r.variable, round(CASE WHEN r.domain = 'P' THEN 0.3 ELSE 0.0 END + CASE WHEN c.variable IS NOT NULL THEN 0.5 ELSE 0.0 END + 0.2 * CASE WHEN length(r.variable) > 8 OR r.variable = '' THEN 0.0 ELSE 0.3 + CASE WHEN starts_with(r.variable, r.domain) THEN 0.4 ELSE 0.0 END + CASE WHEN regexp_full_match(r.variable, '[A-Z0-9_]+') THEN 0.3 ELSE 0.0 END END, 4)::DOUBLE AS validity
    FROM r LEFT JOIN c ON r.domain = c.domain AND r.variable = c.variable""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    name = F.upper(F.substring("p_name", 1, 9)).alias("variable")
    rows = part.select(F.when(F.col("p_size") % 2 == 0, "P").otherwise("Z").alias("domain"), name).distinct()
    return recommend.validation_score(rows, part.where("p_size > 25").select(F.lit("P").alias("domain"), name)).select("domain", "variable", "validity")


@query("t15_tokens", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda w: upper(w)), lambda w, i: regexp_full_match(w, '[A-Z][A-Z0-9_]*') AND list_position(list_transform(string_split(p_name, ' '), lambda v: upper(v)), w) = i), ' ') AS tokens FROM part")
def _(spark, sf):
    expression = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.lit(" = 1"))), " / ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(mapping.variable_tokens(expression), " ").alias("tokens"))


@query("t16_qualifiers", "SELECT o_orderkey, 'C' || o_custkey AS qnam, 'QNAM = ''c' || o_custkey || '''' AS condition FROM orders")
def _(spark, sf):
    e = F.concat(F.lit("QVAL when QNAM = 'c"), F.col("o_custkey").cast("string"), F.lit("'"))
    return table(spark, sf, "orders").select("o_orderkey", mapping.qnam(e).alias("qnam"), mapping.condition(e).alias("condition"))


@query("t21_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not_submitted' WHEN o_custkey % 2 = 0 THEN 'mapped' ELSE 'unmapped' END AS status FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", mapping.status(F.col("o_orderstatus") != "P", F.when(F.col("o_custkey") % 2 == 0, "x")).alias("status"))


@query("t22_clean_expression", "SELECT p_partkey, upper(p_brand) || '=' || upper(p_name) AS expression FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", mapping.clean_expression(F.concat(F.lit(" "), "p_brand", F.lit("  =\t"), "p_name")).alias("expression"))


@query("t23_render", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'QVAL when QNAM = \"F\"' WHEN o_custkey % 2 = 0 THEN 'V when X = 1' ELSE 'V' END AS text FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", mapping.render(F.lit("V"), F.when(F.col("o_custkey") % 2 == 0, "X = 1"), F.when(F.col("o_orderstatus") == "F", "F")).alias("text"))


@query("t25_illegal_names", "SELECT n_nationkey, length(n_name) > 8 OR NOT regexp_full_match(n_name, '[A-Z][A-Z0-9_]*') AS illegal FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", mapping.illegal_name(F.col("n_name")).alias("illegal"))


_WORDS = [("brass", "B"), ("steel", "S"), ("promo", "P")]


@query("t26_first_match", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'B' WHEN contains(lower(p_type), 'steel') THEN 'S' WHEN contains(lower(p_type), 'promo') THEN 'P' ELSE left(p_type, 2) END AS code FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", mapping.first_match(F.col("p_type"), _WORDS, F.substring("p_type", 1, 2)).alias("code"))


@query("t28_all_matches", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(lower(p_type), 'brass') THEN 'B' END, CASE WHEN contains(lower(p_type), 'steel') THEN 'S' END, CASE WHEN contains(lower(p_type), 'promo') THEN 'P' END], lambda x: x IS NOT NULL), ',') AS codes FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(mapping.all_matches(F.col("p_type"), _WORDS), ",").alias("codes"))


@query("t33_source_label", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'Derived' WHEN l_linenumber <= 3 THEN 'CRF Page ' || l_linenumber WHEN l_linestatus = 'F' THEN l_linestatus ELSE 'Assigned' END AS label FROM lineitem")
def _(spark, sf):
    label = mapping.source_label(F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")), F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


@query("t38_assembled_text", "SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type || ' ' || p_brand AS text FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", mapping.assembled([F.col("p_name"), F.col("p_type")], [F.col("p_brand"), F.lit(" ")]).alias("text"))


@query("s10_form_extract", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def _(spark, sf):
    forms = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return sheets.form_extract(table(spark, sf, "lineitem"), forms, "l_returnflag", "l_linestatus", "l_orderkey", "R", "F").select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("s18_standard_chunks", "SELECT r_name || '.' || n_name AS chunk_id, 'Dataset: ' || r_name || ' - region ' || r_regionkey || chr(10) || 'Variable: ' || n_name || chr(10) || 'Label: nation ' || n_nationkey AS chunk_text FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    region = table(spark, sf, "region")
    named = table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("dataset"), F.col("n_name").alias("variable"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("label"), F.lit("").alias("role"))
    return sheets.standard_chunks(named, region.select(F.col("r_name").alias("dataset"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("dataset_label")))


@query("s20_standard_json", "SELECT r_regionkey, r_name, (SELECT string_agg(n_name, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS variables FROM region")
def _(spark, sf):
    variables = table(spark, sf, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("order"), F.col("n_name").alias("variable"))
    return sheets.standard_json(table(spark, sf, "region"), variables, "r_regionkey").select("r_regionkey", "r_name", F.array_join("variables", ",").alias("variables"))


@query("a26_joined_values", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS text FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return sheets.joined_values(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "; ")


@query("a30_first_sources", "SELECT l_suppkey, l_returnflag, arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY ALL")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("seq", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return sheets.first_sources(lines, ["l_suppkey"], "l_returnflag", "seq", "l_partkey")


@query("a39_update_outcomes", "SELECT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'written' ELSE 'skipped' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return sheets.update_plan(table(spark, sf, "orders").select("o_orderkey"), cells, ["o_orderkey"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("j25_parents", "WITH n AS (SELECT DISTINCT upper(p_name) AS name FROM part), k AS (SELECT name || 'CODE' AS name FROM n UNION SELECT name || 'NAME' FROM n) SELECT name, left(name, length(name) - 4) AS parent FROM k")
def _(spark, sf):
    names = table(spark, sf, "part").select(F.upper("p_name").alias("name")).distinct()
    rows = names.select(F.explode(F.array(F.concat("name", F.lit("CODE")), F.concat("name", F.lit("NAME")))).alias("name"))
    return sheets.parents(rows, names, "name", ("CODE", "NAME"))


@query("j29_near_tables", "SELECT r_name, n_name FROM region, nation WHERE contains(lower(n_name), lower(right(r_name, 1))) OR contains(lower(right(r_name, 1)), lower(n_name))")
def _(spark, sf):
    return sheets.near_tables(table(spark, sf, "region").withColumn("ending", F.right("r_name", F.lit(1))), table(spark, sf, "nation"), "ending", "n_name").select("r_name", "n_name")


@query("k03_cell_styles", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'ai_only' WHEN o_custkey % 7 = 0 THEN 'unmapped' WHEN o_totalprice / 500000 >= 0.9 THEN 'score_high' WHEN o_totalprice / 500000 >= 0.7 THEN 'score_medium' ELSE 'score_low' END AS style FROM orders")
def _(spark, sf):
    style = sheets.cell_style(F.col("o_totalprice") / 500000, F.when(F.col("o_custkey") % 7 == 0, "UNMAPPED").otherwise("KB"), F.when(F.col("o_orderstatus") == "P", "ai_only"))
    return table(spark, sf, "orders").select("o_orderkey", style.alias("style"))


@query("k07_report", "WITH x AS (SELECT o_orderpriority AS metric, count(*) FILTER (o_orderkey % 2 = 0) AS base, count(*) FILTER (o_orderkey % 2 = 1) AS now FROM orders GROUP BY 1) SELECT metric, '| ' || metric || ' | ' || base || ' | ' || now || ' | ' || CASE WHEN now >= base - 5 THEN 'pass' ELSE 'FAIL' END || ' |' AS line FROM x")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    half = lambda k: orders.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("value"))
    return sheets.report_rows(evaluate.tolerance(half(1), half(0), 5))


@query("b04_manifest", "SELECT 'unknown:toxic' AS issue, 1 AS n UNION ALL SELECT 'missing:study', 1 UNION ALL SELECT 'blank:quality', count(*) FROM labels WHERE quality IS NULL HAVING count(*) > 0")
def _(spark, sf):
    return sheets.manifest_issues(table(spark, sf, "labels"), ("doc_id", "quality", "study"), ("doc_id", "quality", "study"))


@query("b05_request_volume", "SELECT count(*) FILTER (p_size % 5 = 4) AS model_calls, CAST(ceil(count(DISTINCT p_name) / 100) AS BIGINT) AS embedding_requests FROM part")
def _(spark, sf):
    return recommend.request_volume(table(spark, sf, "part").withColumn("level", F.col("p_size") % 5), "level", "p_name")
