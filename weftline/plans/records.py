"""Queries on readers and writers, record rows, sessions and scores that no other module has, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import mapping, text
from weftline.operators import cascade, evaluate, layout, match, normalise, profile, ranking, recommend, sets, sheets, spec
from weftline.session import dealt, shared_path, table
from weftline.sources import readers, sinks
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


# Readers and writers -------------------------------------------------------------------------------------------------


@query("s02_first_there", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    path = shared_path(spark, "first-there")
    sinks.write_records(table(spark, sf, "nation").select("n_nationkey", "n_name"), f"{path}/new.parquet", "parquet")
    return readers.first_there(spark, [f"{path}/no.parquet", f"{path}/no.json", f"{path}/new.parquet"])


@query("s03_folder_scan", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(spark, sf):
    path = shared_path(spark, "folder")
    orders = table(spark, sf, "orders")
    for status in ("F", "O", "P"):
        orders.where(F.col("o_orderstatus") == status).write.mode("append").parquet(path)
    names = readers.read_folder(spark, path).where("o_orderstatus = 'P'").select("file").distinct()
    return readers.read_folder(spark, path, tuple(r.file for r in names.collect())).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("s05_aliases", "SELECT p_partkey AS key, p_name AS name, p_type AS kind FROM part")
def _(spark, sf):
    wanted = {"key": ["PartKey", "P_PARTKEY"], "name": ["p_name"], "kind": ["no", "D"], "none": ["missing"]}
    return readers.resolve_aliases(table(spark, sf, "part"), wanted, ("key", "name"))


@query("s11_two_sheets", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
def _(spark, sf):
    forms = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return sheets.form_extract(table(spark, sf, "orders"), forms, "o_orderstatus", "o_orderpriority", "o_custkey", "O", "2-HIGH").select("o_orderkey", "c_mktsegment")


@query("s13_json_lines", "SELECT event_id, event_type FROM events WHERE value > 50")
def _(spark, sf):
    path = shared_path(spark, "held-out") + ".jsonl"
    table(spark, sf, "events").where("value > 50").select("event_id", "event_type").write.json(path)
    return readers.read_records(spark, path, "event_id bigint, event_type string")


@query("s19_enriched", "SELECT p_partkey, p_name || coalesce(' | ' || k, '') AS text FROM part LEFT JOIN (SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS k FROM part WHERE p_size > 45 GROUP BY 1) USING (p_brand)")
def _(spark, sf):
    part = table(spark, sf, "part")
    words = part.where("p_size > 45").select("p_brand", F.col("p_type").alias("word"))
    return sheets.enriched(part.select("p_partkey", "p_brand", F.col("p_name").alias("text")), words, "p_brand").select("p_partkey", "text")


@query("s14_nested_outputs", "SELECT o_custkey, o_orderkey FROM orders")
def _(spark, sf):
    nested = sinks.nested(table(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])
    return readers.nested_outputs(nested)


@query("s16_checkpoint", "SELECT l_shipdate::DATE::VARCHAR AS table_name, 'V' || l_orderkey || '_' || l_linenumber AS variable_name, round(l_discount, 2) AS score FROM lineitem WHERE l_quantity = 7")
def _(spark, sf):
    # The temporary checkpoint is another model's, so the finished output counts.
    base = f"{shared_path(spark, 'checkpoint')}/out"
    lines = table(spark, sf, "lineitem").where("l_quantity = 7")
    rec = F.struct(F.concat(F.lit("V"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("variable_name"), F.round("l_discount", 2).alias("score"))
    by = lines.groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("table_name")).agg(F.collect_list(rec).alias("domain_recommendations"))
    by.write.json(f"{base}.json")
    old = by.limit(1).select(F.array(F.struct("table_name", "domain_recommendations")).alias("recommendations"), F.lit("other").alias("model_name"))
    old.write.json(f"{base}.tmp.json")
    return readers.checkpoint(spark, base, model="mine").select("table_name", "variable_name", "score")


@query(
    "s17_catalogue",
    """SELECT upper(trim(p_brand)) AS domain, CASE WHEN p_brand = 'Brand#1' THEN 'safety' ELSE 'other' END AS category, trim(p_name) AS variable, min(p_partkey) AS seq FROM part WHERE trim(p_name) NOT IN ('red bolt') GROUP BY ALL""",
)
def _(spark, sf):
    path = shared_path(spark, "catalogue")
    part = table(spark, sf, "part")
    rows = part.select("p_brand", F.when(F.col("p_name") == "red bolt", "STUDYID").otherwise(F.concat(F.lit(" "), "p_name")).alias("variable"), F.col("p_partkey").alias("seq"))
    rows.select(F.lower("p_brand").alias("domain"), "variable", F.lit("x").alias("label"), "seq").write.parquet(f"{path}/older.parquet")
    known = spark.createDataFrame([("BRAND#1", "safety")], "domain string, category string")
    return readers.catalogue(spark, [f"{path}/none.json"], [f"{path}/none.parquet", f"{path}/older.parquet"], known).select("domain", "category", "variable", "seq")


@query("k01_json_records", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    path = shared_path(spark, "records") + ".json"
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    sinks.write_records(nation, path, "json")
    return readers.read_records(spark, path, "n_nationkey int, n_name string")


@query("k02_replaced_table", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, sf):
    path = shared_path(spark, "replaced")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    sinks.replace_table(supplier, path)
    sinks.replace_table(supplier.where("s_suppkey % 2 = 0"), path)
    return spark.read.parquet(path)


@query("k04_csv_export", "SELECT p_partkey, p_name, p_type FROM part WHERE p_brand = 'Brand#3'")
def _(spark, sf):
    path = shared_path(spark, "export") + ".csv"
    rows = table(spark, sf, "part").where("p_brand = 'Brand#3'").select("p_partkey", "p_name", "p_type")
    sinks.write_records(rows, path, "csv")
    return readers.read_records(spark, path, "p_partkey bigint, p_name string, p_type string")


@query("k09_four_fields", "SELECT p_brand, p_name, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf):
    path = shared_path(spark, "four-fields") + ".json"
    rows = table(spark, sf, "part").where("p_partkey % 3 = 0").select("p_brand", "p_name", "p_type", F.col("p_size").cast("string").alias("p_size"))
    sinks.write_records(rows, path, "json")
    return readers.read_records(spark, path, "p_brand string, p_name string, p_type string, p_size string")


@query("k05_audit_log", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path = shared_path(spark, "log")
    for _ in range(2):
        sinks.append_log(table(spark, sf, "events").select("event_id", "event_type"), path)
    return spark.read.schema("event_id bigint, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


# Filters and projections ---------------------------------------------------------------------------------------------


@query("f01_visible_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE trim(l_returnflag) = 'A' AND trim(l_linestatus) = 'F'")
def _(spark, sf):
    nothing = spark.createDataFrame([], "l_orderkey bigint, form string")
    return sheets.form_extract(table(spark, sf, "lineitem"), nothing, "l_returnflag", "l_linestatus", "l_orderkey", "A", "F").select("l_orderkey", "l_linenumber")


@query("f03_valid_records", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> '' AND CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN 'x' END <> ''")
def _(spark, sf):
    target = F.when(F.col("o_custkey") % 3 == 0, "").when(F.col("o_custkey") % 3 == 1, "x")
    return table(spark, sf, "orders").where(text.filled(F.col("o_orderstatus"), target)).select("o_orderkey")


@query("f10_score_threshold", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.07")
def _(spark, sf):
    return ranking.above(table(spark, sf, "lineitem"), "l_discount", 0.07).select("l_orderkey", "l_linenumber")


@query("f14_cleaned_rows", "SELECT o_orderkey AS variable_name, o_orderpriority AS domain, CASE WHEN o_orderstatus = 'F' THEN 'SUPPX' END AS supp_dataset, CASE WHEN o_totalprice > 100000 THEN o_totalprice ELSE 0.9 END AS score FROM orders")
def _(spark, sf):
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("variable_name"), F.col("o_orderpriority").alias("domain"), none.alias("sdtm_variable"), F.when(F.col("o_orderstatus") == "F", "Supp").otherwise("standard").alias("kind"),
        F.lit("SUPPX").alias("supp_dataset"), none.alias("supp_variable"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("score"), none.alias("testcd"), none.alias("source"),
    )
    return normalise.cleaned(rows).select("variable_name", "domain", "supp_dataset", "score")


@query("f16_report_labels", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN upper(event_type) ELSE 'OTHER' END AS label FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", text.report_label(F.concat(F.lit(" "), "event_type"), ("CLICK", "VIEW")).alias("label"))


@query("f17_allowed_metrics", "SELECT count(*) AS n, round(avg(l_tax), 6) AS tax FROM lineitem")
def _(spark, sf):
    metrics = table(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.round(F.avg("l_tax"), 6).alias("tax"), F.max("l_orderkey").alias("secret"))
    return sheets.allowed_metrics(metrics, ("n", "tax", "absent"))


# Joins ---------------------------------------------------------------------------------------------------------------

@query("j08_two_keys", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN (SELECT DISTINCT l_orderkey AS ok, l_partkey AS pk, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 5) k ON l_orderkey = ok AND l_partkey = pk")
def _(spark, sf):
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part").where("p_size <= 5")
    forms = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", "p_name").distinct()
    return lines.join(forms, ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_linenumber", "p_name")


@query(
    "j10_left_best",
    """SELECT o_orderkey, l_partkey AS best_part FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.05 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey) = 1) ON o_orderkey = l_orderkey""",
)
def _(spark, sf):
    recs = table(spark, sf, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("best_part"), "l_discount", "l_linenumber")
    # Line numbers may repeat within an order here; the part decides then.
    recs = recs.groupBy("o_orderkey", "l_discount", "l_linenumber").agg(F.min("best_part").alias("best_part"))
    return match.left_best(table(spark, sf, "orders").select("o_orderkey"), recs, "o_orderkey", "l_discount", "l_linenumber")


@query("j21_template_lookup", "WITH t AS (SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey DESC) = 1) SELECT p.p_partkey, t.p_partkey AS last_row FROM part p LEFT JOIN t USING (p_brand, p_type)")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    template = part.select("p_brand", "p_type", F.col("p_partkey").alias("last_row"))
    return match.last_wins(part, template, ["p_brand", "p_type"], F.col("last_row").desc()).select("p_partkey", "last_row")


@query("j24_cross_references", "SELECT n_name AS sheet, n_nationkey AS row, r_regionkey AS col, 'see ' || r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AND r_name <> 'ASIA'")
def _(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    templates = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sheet"), F.col("r_name").alias("variable"), F.col("n_nationkey").alias("row"), F.col("r_regionkey").alias("col"))
    rules = region.where("r_name <> 'ASIA'").select(F.col("r_name").alias("variable"), F.lit("HOME").alias("source_sheet"), F.concat(F.lit("see "), "r_name").alias("value"))
    updates = table(spark, sf, "customer").where("c_acctbal > 9000").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("sheet"))
    return match.cross_references(templates, updates, rules)


@query("j26_unknown_domains", "SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _(spark, sf):
    known = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return match.not_in(table(spark, sf, "customer"), known, "c_nationkey")


@query("j27_resume_pairs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_quantity > 40)")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_returnflag is not null")
    done = lines.where("l_returnflag = 'R' or l_quantity > 40")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    return streams.resume(lines.select(*keys), done, keys).select("l_orderkey", "l_linenumber")


@query("j30_update_by_key", "SELECT n_nationkey, n_nationkey < 10 AS written FROM nation")
def _(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey")
    plan = sheets.update_plan(nation, nation.where("n_nationkey < 10"), ["n_nationkey"])
    return plan.select("n_nationkey", (F.col("outcome") == "written").alias("written"))


@query(
    "m02_live_cascade",
    """WITH i AS (SELECT o_orderkey AS key, max(l_discount * 9) AS confidence, bool_or(l_quantity = 50) AS direct FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'A' GROUP BY 1),
    t AS (SELECT l_orderkey AS key, max(l_tax * 10) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    v AS (SELECT i.*, top, CASE WHEN confidence >= 0.8 AND (coalesce(direct, false) OR confidence >= 0.85) THEN 1 WHEN confidence >= 0.8 THEN 2 WHEN top >= 0.7 THEN 3 ELSE 4 END AS level FROM i LEFT JOIN t USING (key))
    SELECT level, source, count(*) AS n, round(sum(score), 4) AS total FROM (
      SELECT level, 'KB' AS source, l_discount * 9 AS score FROM v JOIN lineitem ON key = l_orderkey WHERE level <= 3 AND l_returnflag = 'A' UNION ALL
      SELECT level, 'RAG', l_tax * 10 FROM v JOIN lineitem ON key = l_orderkey WHERE level = 3 AND l_returnflag = 'R' UNION ALL
      SELECT level, 'LLM', NULL FROM v WHERE level = 4) GROUP BY ALL""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("seq"), F.lit("D").alias("domain"), F.lit("V").alias("variable"), "l_discount", "l_tax", "l_quantity", "l_returnflag")
    kb = lines.where("l_returnflag = 'A'").withColumn("score", F.col("l_discount") * 9)
    rag = lines.where("l_returnflag = 'R'").withColumn("score", F.col("l_tax") * 10)
    own = kb.groupBy("key").agg(F.max("score").alias("confidence"), F.bool_or(F.col("l_quantity") == 50).alias("direct"))
    inputs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")).join(own, "key", "left")
    found = cascade.live_cascade(inputs, kb, rag)
    return found.groupBy("level", "source").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


# Aggregations and order ----------------------------------------------------------------------------------------------


@query("a18_quality_counters", "SELECT count(*) FILTER (l_discount = 0) AS n_free, count(*) FILTER (l_quantity > 45) AS n_large, count(*) FILTER (l_returnflag IS NULL) AS n_blank FROM lineitem")
def _(spark, sf):
    return evaluate.quality_counters(table(spark, sf, "lineitem"), {"n_free": F.col("l_discount") == 0, "n_large": F.col("l_quantity") > 45, "n_blank": F.col("l_returnflag").isNull()})


@query("a23_failures", "SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P')) AS n_failed, (SELECT count(*) FROM (SELECT DISTINCT user_id, value FROM events WHERE event_type = 'error')) AS n_errors")
def _(spark, sf):
    recs = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("table_name"), F.lit("").alias("variable_name"), F.col("o_orderpriority").alias("sdtm_variable"), F.when(F.col("o_orderstatus") == "P", "fallback").otherwise("KB").alias("source"))
    issues = table(spark, sf, "events").select(F.col("event_type").alias("severity"), "user_id", "value")
    return sheets.failures(recs, issues)


@query("a28_assignments", "SELECT l_suppkey, string_agg(v, ';' || chr(10) ORDER BY first) AS text, count(*) AS n FROM (SELECT l_suppkey, l_returnflag || '=' || l_linestatus AS v, min((l_orderkey, l_linenumber, l_partkey)) AS first FROM lineitem GROUP BY ALL) GROUP BY 1")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", F.concat_ws("=", "l_returnflag", "l_linestatus").alias("v"), "l_orderkey", "l_linenumber", "l_partkey")
    return spec.ordered_strings(lines, ["l_suppkey"], "v", "l_orderkey", "l_linenumber", "l_partkey")


@query("a29_test_rows", "SELECT p_brand, string_agg(DISTINCT p_type, chr(10) ORDER BY p_type) AS text FROM part GROUP BY 1")
def _(spark, sf):
    return sheets.joined_values(table(spark, sf, "part"), ["p_brand"], "p_type", "\n")


@query("a34_outline_levels", "SELECT o_custkey, level, n FROM (SELECT o_custkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS level, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, level) = 1")
def _(spark, sf):
    outline = table(spark, sf, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    return layout.outline_level(outline, "o_custkey")


@query("a36_modal_size", "SELECT source, size, n FROM (SELECT source, round(n_chars % 7, 1)::DOUBLE AS size, CAST(sum(length(lang)) AS BIGINT) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, size) = 1")
def _(spark, sf):
    lines = table(spark, sf, "documents").select("source", (F.col("n_chars") % 7).cast("double").alias("size"), F.col("lang").alias("text"))
    return layout.modal_size(lines, "source").select("source", "size", F.col("n").cast("long").alias("n"))


@query("a38_garbled_ratio", "SELECT doc_id, round(CASE WHEN length(t) > 0 THEN (length(t) - length(replace(t, 'e', ''))) / length(t) ELSE 0.0 END, 6) AS ratio FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(profile.garbled_ratio(text.blank(F.col("text")), "e"), 6).alias("ratio"))


@query("a40_severity_counts", "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_or(event_type = 'warning') THEN 'warning' ELSE 'none' END AS worst, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    severity = F.when(F.col("event_type").isin("error", "warning"), F.col("event_type")).otherwise("none")
    return profile.severities(table(spark, sf, "events").select("user_id", severity.alias("severity")), "user_id", "severity")


@query("w05_latest_ingest", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) = 1")
def _(spark, sf):
    return ranking.latest(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "c_acctbal")


@query("w09_by_score", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem")
def _(spark, sf):
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ranking.by_score(table(spark, sf, "lineitem").withColumn("seq", seq), "l_orderkey", "l_discount", "seq").select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("w11_numeric_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY try_cast(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS DOUBLE) NULLS LAST, event_id) AS place FROM events")
def _(spark, sf):
    number = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("value").cast("string"))
    w = Window.partitionBy("user_id").orderBy(mapping.number_order(number), "event_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(w).alias("place"))


@query("w12_row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS number FROM orders")
def _(spark, sf):
    return ranking.numbered(table(spark, sf, "orders").select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey").select("o_orderkey", "number")


@query("w15_severity_order", "SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", ranking.severity_order(F.upper("event_type")).alias("severity"))


@query("w16_first_five", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5")
def _(spark, sf):
    return ranking.top_by(table(spark, sf, "events"), ["user_id"], 5, F.col("event_id")).select("user_id", "event_id")


@query("w18_candidate_domains", "WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS place FROM orders GROUP BY ALL) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY place) <= 3")
def _(spark, sf):
    return ranking.ordered_distinct(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority", 3).drop("rank")


@query("u02_union_sorted", "SELECT o_orderkey AS num FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_quantity = 1")
def _(spark, sf):
    one = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("num"))
    return sets.union_sorted("num", one, table(spark, sf, "lineitem").where("l_quantity = 1").select(F.col("l_orderkey").alias("num")))


@query("u08_path_diff", "SELECT n_nationkey AS path, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS old, CASE WHEN n_nationkey % 6 = 0 THEN 'new' WHEN n_nationkey < 20 THEN n_name END AS new FROM nation WHERE CASE WHEN n_nationkey % 4 <> 0 THEN n_name END IS DISTINCT FROM CASE WHEN n_nationkey % 6 = 0 THEN 'new' WHEN n_nationkey < 20 THEN n_name END")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    old = nation.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("path"), F.col("n_name").alias("value"))
    new = nation.where("n_nationkey < 20 or n_nationkey % 6 = 0").select(F.col("n_nationkey").alias("path"), F.when(F.col("n_nationkey") % 6 == 0, "new").otherwise(F.col("n_name")).alias("value"))
    return sets.path_diff(old, new)


# Texts ---------------------------------------------------------------------------------------------------------------


@query("t11_kinds", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not_submitted' WHEN o_custkey % 2 = 0 THEN 'supp' ELSE 'standard' END AS kind FROM orders")
def _(spark, sf):
    kind = normalise.classify(F.when(F.col("o_custkey") % 2 == 0, "suppdm").otherwise("DM"), F.when(F.col("o_orderstatus") == "P", "Not submitted").otherwise("X"))
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"))


@query(
    "t13_supp_records",
    """WITH r AS (SELECT p_partkey, p_size % 3 AS kind, upper(left(regexp_replace(p_name, '[^a-z]', '', 'g'), 8)) AS name FROM part)
    SELECT p_partkey, CASE WHEN kind = 0 THEN 'GIVEN' WHEN kind = 1 THEN name ELSE 'OTHER' END AS supp_variable, CASE WHEN p_partkey % 2 = 0 THEN 'SUPPAE' ELSE 'SUPPXX' END AS supp_dataset FROM r""",
)
def _(spark, sf):
    kind = F.col("p_size") % 3
    name = F.substring(F.regexp_replace("p_name", "[^a-z]", ""), 1, 8)
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 2 == 0, "suppae").alias("domain"), F.when(kind == 2, F.lit("qval")).otherwise(name).alias("variable_name"),
        F.when(kind == 0, "given").when(kind == 2, "AETERM").alias("supp_variable"), F.when(kind == 2, "other").alias("sdtm_variable"), (kind == 1).alias("auto_corrected"), F.lit("").alias("supp_dataset"),
    )
    catalogue = spark.createDataFrame([("AE", "AETERM"), ("", "AETERM")], "domain string, variable string")
    return normalise.supp_records(rows, catalogue).select("p_partkey", "supp_variable", "supp_dataset")


@query(
    "t17_validated",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'AE' ELSE 'ZZ' END AS domain, upper(replace(p_name, ' ', '')) AS v, p_size % 10 / 10 AS s FROM part), k AS (SELECT DISTINCT left(upper(replace(p_name, ' ', '')), 8) AS v FROM part WHERE p_size > 40),
    c AS (SELECT p_partkey, domain, left(v, 8) AS variable, CASE WHEN domain = 'ZZ' THEN least(s * 0.7, 0.6) ELSE s END AS a, length(v) > 8 AS long FROM r)
    SELECT p_partkey, variable, round(CASE WHEN long THEN least(a * 0.6, 0.5) ELSE a END, 4) AS score, CASE WHEN domain = 'AE' AND variable IN (SELECT v FROM k) THEN 'Pass' ELSE 'Fail' END AS check FROM c""",
)
def _(spark, sf):
    part = table(spark, sf, "part").withColumn("variable", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))))
    rows = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "AE").otherwise("ZZ").alias("domain"), "variable", F.lit("standard").alias("kind"), (F.col("p_size") % 10 / 10).alias("score"))
    known = part.where("p_size > 40").select(F.lit("AE").alias("domain"), F.substring("variable", 1, 8).alias("variable"))
    return normalise.validate(rows, known, ["AE"]).select("p_partkey", "variable", "score", "check")


@query("t19_standard_check", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Skip' WHEN p_name IN (SELECT p_name FROM part WHERE p_size > 45) THEN 'Pass' ELSE 'Fail' END AS check FROM (SELECT p_partkey, p_size, left(p_name, 8) AS p_name FROM part)".replace("SELECT p_name FROM part WHERE", "SELECT left(p_name, 8) FROM part WHERE"))
def _(spark, sf):
    part = table(spark, sf, "part").withColumn("variable", F.substring("p_name", 1, 8))
    rows = part.select("p_partkey", F.lit("P").alias("domain"), "variable", F.when(F.col("p_size") % 5 == 0, "supp").otherwise("standard").alias("kind"), F.lit(1.0).alias("score"))
    return normalise.validate(rows, part.where("p_size > 45").select(F.lit("P").alias("domain"), "variable"), ["P"]).select("p_partkey", "check")


@query(
    "t27_domain_waterfall",
    """SELECT p_partkey, CASE WHEN p_name IN ('red bolt', 'blue bolt') THEN 'EXACT' WHEN contains(p_name, 'widget') THEN 'WORD' WHEN contains(p_name, 'small') THEN 'SIZE' ELSE p_type END AS domain FROM part""",
)
def _(spark, sf):
    exact = F.when(F.col("p_name").isin("red bolt", "blue bolt"), F.lit("EXACT"))
    found = F.coalesce(exact, mapping.first_match(F.col("p_name"), [("WIDGET", "WORD"), ("small", "SIZE")], mapping.base_domain(F.concat(F.lit("supp"), "p_type"))))
    return table(spark, sf, "part").select("p_partkey", found.alias("domain"))


@query("t30_conditions", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'QNAM = \"Q' || left(o_orderpriority, 1) || o_orderstatus || '\"' ELSE 'STATUS = ' || o_orderstatus END AS condition, CASE WHEN o_custkey % 2 = 0 THEN 'Q' || left(o_orderpriority, 1) || o_orderstatus ELSE '' END AS qnam FROM orders")
def _(spark, sf):
    """Conditions with and without a qualifier."""
    name = F.concat(F.lit("Q"), F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"))
    e = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('QVAL when QNAM = "'), name, F.lit('"'))).otherwise(F.concat(F.lit("VAR if STATUS = "), "o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", mapping.condition(e).alias("condition"), mapping.qnam(e).alias("qnam"))


@query("t31_references", "SELECT o_orderkey, o_orderpriority || ' when ' || o_orderstatus AS reference FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", mapping.render(F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit("")).alias("reference"))


@query("t36_masked_fields", "SELECT event_id, '[REDACTED] x' AS a, props AS b FROM events")
def _(spark, sf):
    made = F.create_map(F.lit("a"), F.lit("someone@example.org x"), F.lit("b"), F.col("props"))
    masked = table(spark, sf, "events").select("event_id", text.mask_map(made).alias("m"))
    return masked.select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("t39_search_text", "SELECT p_partkey, p_name || ' ' || p_name || ' ' || p_brand || ' ' || p_type AS text FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", mapping.assembled([F.col("p_name"), F.lit(None)], [F.col("p_brand"), F.col("p_type")]).alias("text"))


@query("t41_session_chunks", "SELECT left(sha256('upload.xlsx'), 16) || '_' || p_partkey AS chunk_id, '表: ' || p_brand || ' | 变量: ' || p_name || ' | SDTM_Domain: ' || p_type AS chunk_text, p_partkey AS row_index FROM part")
def _(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("Annotation_Table"), F.col("p_name").alias("metadata_variable"), F.col("p_type").alias("SDTM_Domain"), F.lit("nan").alias("SDTM_Variable"))
    return sheets.session_chunks(rows, "upload.xlsx", "p_partkey").select("chunk_id", "chunk_text", "row_index")


@query("t45_clean_labels", "SELECT p_partkey, p_name AS label FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.clean_label(F.concat(F.lit(" 3) "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit(" :"))).alias("label"))


@query("t46_wrapped_lines", "SELECT o_custkey, count(*) AS lines, CAST(sum(n) AS BIGINT) AS texts FROM (SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, sum(CASE WHEN gap <= 1 AND NOT ended THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY top) AS b FROM (SELECT o_custkey, top, top - (lag(top) OVER w + 1) AS gap, lag(o_orderstatus) OVER w = 'F' AS ended FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * (1 + o_custkey % 2 * 2) AS top, o_orderstatus FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY top))) GROUP BY o_custkey, b) GROUP BY 1")
def _(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    lines = table(spark, sf, "orders").select("o_custkey", (n * (1 + F.col("o_custkey") % 2 * 2)).cast("double").alias("top"), F.when(F.col("o_orderstatus") == "F", "end.").otherwise("on").alias("text"), F.lit(1.0).alias("x0"))
    merged = layout.merged_lines(lines.withColumn("bottom", F.col("top") + 1), "o_custkey", 1.0)
    return merged.groupBy("o_custkey").agg(F.count("*").alias("lines"), F.sum(F.size(F.split("text", " "))).alias("texts"))


@query(
    "t46_grid_cells",
    """WITH w AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS top, l_linestatus AS s, l_returnflag AS text FROM lineitem), c AS (SELECT *, CASE WHEN s = 'F' THEN 1 ELSE 2 END AS k FROM w)
    SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY top) AS row, dense_rank() OVER (PARTITION BY page ORDER BY k) AS "column", string_agg(text, ' ' ORDER BY x, text) AS text FROM (SELECT *, k * 100 + CASE text WHEN 'A' THEN 0 WHEN 'N' THEN 10 ELSE 20 END AS x FROM c) GROUP BY page, top, k""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("top"), F.col("l_linestatus").alias("s"), F.col("l_returnflag").alias("text"))
    lines = dealt(lines, lines.count(), "page").distinct()
    x = F.when(F.col("s") == "F", 100).otherwise(200) + F.when(F.col("text") == "A", 0).when(F.col("text") == "N", 10).otherwise(20)
    words = lines.withColumn("x0", x.cast("double")).withColumn("x1", F.col("x0") + 8)
    return layout.grid_cells(words, "page", 15.0)


@query("t47_words_by_gaps", "SELECT l_orderkey, count(*) AS words FROM (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS gap FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE gap IS NULL OR gap > 1 GROUP BY 1")
def _(spark, sf):
    chars = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("x0")).distinct().withColumn("text", F.lit("c"))
    return layout.words(chars, ["l_orderkey"], 1.0).groupBy("l_orderkey").agg(F.count("*").alias("words"))


@query("t49_functional_queries", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Map subject identifier field' WHEN 'ECONOMY' THEN 'Map the main topic field for ' || lower(p_brand) ELSE 'Map field for ' || lower(p_brand) END AS question FROM part")
def _(spark, sf):
    role = F.when(F.col("p_type") == "SMALL", "Identifier").when(F.col("p_type") == "ECONOMY", "Topic").otherwise("x")
    return table(spark, sf, "part").select("p_partkey", text.functional_query(role, F.col("p_brand")).alias("question"))


@query("t50_label_lines", "SELECT p_partkey, p_name AS label FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.label_line(F.concat(F.lit("Type: x\nLabel: "), "p_name", F.lit("\nOrder: 3"))).alias("label"))


# Models and caches ---------------------------------------------------------------------------------------------------


def _sizes(texts):
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query("v05_distinct_embeddings", "SELECT DISTINCT p_name AS text, length(p_name)::DOUBLE AS a, (length(p_name) - length(replace(p_name, 'e', '')))::DOUBLE AS b FROM part")
def _(spark, sf):
    found = recommend.embed_distinct(table(spark, sf, "part"), "p_name", _sizes, 10)
    return found.select("text", F.get("embedding", F.lit(0)).alias("a"), F.get("embedding", F.lit(1)).alias("b"))


@query("v06_cached_vectors", "SELECT DISTINCT p_name AS text FROM part")
def _(spark, sf):
    folder, part = shared_path(spark, "vectors"), table(spark, sf, "part")
    make = lambda df: recommend.embed_distinct(df, "p_name", _sizes)
    recommend.cached(spark, folder, F.col("p_name"), part, make)
    return recommend.cached(spark, folder, F.col("p_name"), part, make).select("text")


def _answer(prompt: str) -> str:
    if prompt.startswith("ECONOMY"):
        raise ValueError("no answer")
    return prompt.lower()


@query("m04_inference", "SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN lower(p_type) END AS answer, p_type = 'ECONOMY' AS failed FROM part")
def _(spark, sf):
    return recommend.infer(table(spark, sf, "part"), "p_partkey", "p_type", _answer)
