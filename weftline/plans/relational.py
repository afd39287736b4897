"""Queries on scans, filters, joins, aggregations, ranking and sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import intervals, match, profile, ranking, sets, spec
from weftline.session import dealt, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Registers a query (spark, sf_dir) with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


#: Unicode white space as a SQL string, and the SQL of deep normalisation.
_WHITE = f"'{text.WHITE}'"
_DEEP = f"translate(regexp_replace(lower(trim(coalesce({{0}}, ''), {_WHITE})), '{text.BRACKETED}', '', 'g'), '{text.SLASHES + text.WHITE + text.PUNCTUATION}', '')"


# Scans and filters ---------------------------------------------------------------------------------------------------


@query("s01_scan_filter", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_size >= 40 AND trim(p_brand) <> ''")
def _(spark, sf):
    return table(spark, sf, "part").where("p_size >= 40 AND trim(p_brand) <> ''").select("p_partkey", "p_name", "p_brand")


@query("f02_drop_sentinels", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE upper(trim(l_returnflag)) NOT IN ('', 'N')")
def _(spark, sf):
    return table(spark, sf, "lineitem").where(~F.upper(F.trim("l_returnflag")).isin("", "N")).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("f04_regex_search", "SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(p_name, '(?i)a.*e') OR regexp_matches(p_type, '(?i)brass$')")
def _(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").rlike("(?i)a.*e") | F.col("p_type").rlike("(?i)brass$")).select("p_partkey", "p_name", "p_type")


@query("f05_point_lookup", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_partkey = 42")
def _(spark, sf):
    return table(spark, sf, "part").where("p_partkey = 42").select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("f06_token_filter", "SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda t: starts_with(t, 's'))) > 0")
def _(spark, sf):
    return table(spark, sf, "part").where(F.exists(F.split(F.lower("p_name"), " "), lambda t: t.startswith("s"))).select("p_partkey", "p_name")


@query(
    "f11_flagged_group_semi",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (
    SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) >= 0.9)""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return lines.join(profile.flagged_groups(lines, "l_orderkey", F.col("l_returnflag") == "R"), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("f15_source_labels", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'KB' WHEN o_orderstatus = 'O' THEN 'RAG' WHEN o_orderstatus = 'P' THEN 'LLM' ELSE 'UNMAPPED' END AS label FROM orders")
def _(spark, sf):
    label = F.when(F.col("o_orderstatus") == "F", "KB").when(F.col("o_orderstatus") == "O", "RAG").when(F.col("o_orderstatus") == "P", "LLM").otherwise("UNMAPPED")
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"))


# Joins ---------------------------------------------------------------------------------------------------------------


@query(
    "j01_exact_merge",
    f"""WITH k AS (SELECT doc_id, source, lang, lower(trim(text, {_WHITE})) || '|||' || lower(trim(lang, {_WHITE})) AS key FROM documents WHERE trim(text, {_WHITE}) <> '' AND trim(lang, {_WHITE}) <> '')
    SELECT md5(key) AS key, count(*) AS n, string_agg(doc_id || ':' || source, ',' ORDER BY doc_id) AS suggestions FROM k GROUP BY key""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    found = match.exact_merge(docs, docs, ["text", "lang"], ["doc_id", "source"])
    listed = F.array_join(F.transform("suggestions", lambda s: F.concat_ws(":", s["doc_id"].cast("string"), s["source"])), ",")
    return found.select(F.col("key_hash").alias("key"), "n", listed.alias("suggestions"))


@query(
    "j02_lower_join",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag AS t, l_linestatus || ' ' AS v FROM lineitem), k AS (SELECT min(o_orderkey) AS other, lower(o_orderstatus) AS v, 'r' AS t FROM orders GROUP BY o_orderstatus UNION ALL SELECT 0, 'F ', 'A')
    SELECT l_orderkey, l_linenumber, other, CAST(1.0 AS DOUBLE) AS confidence FROM p JOIN k ON lower(p.t) = lower(k.t) AND lower(p.v) = lower(k.v)""",
)
def _(spark, sf):
    probe = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("t"), F.concat("l_linestatus", F.lit(" ")).alias("v"))
    kb = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("other")).select("other", F.lower("o_orderstatus").alias("kv"), F.lit("r").alias("kt"))
    kb = kb.unionAll(spark.range(1).select(F.lit(0).cast("long"), F.lit("F "), F.lit("A")))
    return match.lower_join(probe, kb, [("t", "kt"), ("v", "kv")]).select("l_orderkey", "l_linenumber", "other", "confidence")


@query(
    "j03_deep_norm_join",
    f"""WITH d AS (SELECT doc_id, {_DEEP.format("text")} AS k FROM documents)
    SELECT a.doc_id AS doc_id, b.doc_id AS other_id, CAST(0.95 AS DOUBLE) AS confidence FROM d a JOIN (SELECT min(doc_id) AS doc_id, k FROM d GROUP BY k) b ON a.k = b.k WHERE a.k <> '' AND a.doc_id <> b.doc_id""",
)
def _(spark, sf):
    found = match.first_of_key(table(spark, sf, "documents"), "doc_id", ["text"])
    return found.select("doc_id", F.col("first").alias("other_id"), F.lit(0.95).alias("confidence"))


@query(
    "j04_blocked_fuzzy",
    """WITH n AS (SELECT DISTINCT p_brand, lower(p_name) AS a FROM part), s AS (
    SELECT x.p_brand, x.a, y.a AS b, CASE WHEN x.a = y.a THEN 1.0 ELSE least(length(x.a), length(y.a)) / greatest(length(x.a), length(y.a)) END AS similarity
    FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.a <> y.a AND (contains(x.a, y.a) OR contains(y.a, x.a))),
    r AS (SELECT *, rank() OVER (PARTITION BY p_brand, a ORDER BY similarity DESC) AS r FROM s WHERE similarity >= 0.5)
    SELECT p_brand, a, b, round(similarity, 6) AS similarity FROM r WHERE r = 1""",
)
def _(spark, sf):
    names = table(spark, sf, "part").select("p_brand", F.lower("p_name").alias("a")).distinct()
    other = names.withColumnRenamed("a", "b")
    pairs = match.blocked_fuzzy(names, other, "p_brand", "a", "b", least=0.5, native=True, same=False)
    return pairs.select("p_brand", "a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "j06_strategy_cascade",
    f"""WITH p AS (SELECT p_partkey, p_name, p_type FROM part WHERE p_partkey % 2 = 0), k AS (SELECT p_partkey AS kb_key, p_name, p_type FROM part WHERE p_partkey % 2 = 1),
    e AS (SELECT DISTINCT p.p_partkey FROM p JOIN k ON lower(trim(p.p_name)) = lower(trim(k.p_name)) AND lower(p.p_type) = lower(k.p_type)),
    d AS (SELECT DISTINCT p.p_partkey FROM p JOIN k ON {_DEEP.format("p.p_name")} = {_DEEP.format("k.p_name")} WHERE p.p_partkey NOT IN (SELECT p_partkey FROM e)),
    b AS (SELECT DISTINCT p.p_partkey FROM p JOIN k ON p.p_type = k.p_type AND (contains(lower(p.p_name), lower(k.p_name)) OR contains(lower(k.p_name), lower(p.p_name)))
      WHERE p.p_partkey NOT IN (SELECT p_partkey FROM e) AND p.p_partkey NOT IN (SELECT p_partkey FROM d))
    SELECT stage, count(*) AS n FROM (SELECT 'exact' AS stage, * FROM e UNION ALL SELECT 'deep', * FROM d UNION ALL SELECT 'blocked', * FROM b) GROUP BY stage""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    probe, kb = part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1").select(F.col("p_name").alias("kb_name"), F.col("p_type").alias("kb_type"))

    # Each stage asks whether a row has a match, so records that are equal for it are one.
    names = kb.distinct()

    def exact(left):
        there = names.select(text.normalise(F.col("kb_name")).alias("kb_name"), F.lower("kb_type").alias("kb_type")).distinct()
        return left.join(there, (text.normalise(F.col("p_name")) == F.col("kb_name")) & (F.lower("p_type") == F.col("kb_type")), "left_semi").select("p_partkey").distinct()

    def deep(left):
        return match.deep_matched(left, names, [("p_name", "kb_name")]).select("p_partkey").distinct()

    def blocked(left):
        mine = left.select("p_type", F.lower("p_name").alias("name")).distinct()
        there = names.select("kb_type", F.lower("kb_name").alias("kb_name")).distinct()
        near = mine.join(there, F.col("p_type") == F.col("kb_type")).where(text.containment(F.col("name"), F.col("kb_name")).isNotNull()).select("p_type", "name").distinct()
        return left.withColumn("name", F.lower("p_name")).join(near, ["p_type", "name"], "left_semi").select("p_partkey").distinct()

    return match.staged(probe, "p_partkey", [("exact", exact), ("deep", deep), ("blocked", blocked)]).groupBy("stage").agg(F.count("*").alias("n"))


@query("j07_two_key_inner", "SELECT l_orderkey, l_partkey, l_linenumber, o_orderdate, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size = 1 AND o_orderstatus = 'F'")
def _(spark, sf):
    lines, orders, part = (table(spark, sf, n) for n in ("lineitem", "orders", "part"))
    both = lines.join(orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(part.where("p_size = 1"), F.col("l_partkey") == F.col("p_partkey"))
    return both.select("l_orderkey", "l_partkey", "l_linenumber", "o_orderdate", "p_name")


@query("j09_left_parent", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    customer, nation, region = (table(spark, sf, n) for n in ("customer", "nation", "region"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("j11_fanout_left", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def _(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "j12_last_wins_lookup",
    """WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT c_custkey, o_orderkey AS last_order, CASE WHEN o_orderkey IS NULL THEN 'ref_only' WHEN o_orderstatus = 'F' THEN 'match' ELSE 'var_diff' END AS status FROM customer LEFT JOIN l ON c_custkey = o_custkey""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderdate")
    joined = match.last_wins(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    status = F.when(F.col("o_orderkey").isNull(), "ref_only").when(F.col("o_orderstatus") == "F", "match").otherwise("var_diff")
    return joined.select("c_custkey", F.col("o_orderkey").alias("last_order"), status.alias("status"))


@query("j13_lookup_number", "SELECT s_suppkey, s_name, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name", "n_regionkey")


@query(
    "j15_paired_runs",
    """SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS n_high, b.n AS n_low, a.n IS NULL OR b.n IS NULL AS unpaired
    FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice >= 150000 GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice < 150000 GROUP BY 1) b ON a.o_custkey = b.o_custkey""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    count = lambda df, name: df.groupBy("o_custkey").agg(F.count("*").alias(name))
    return match.paired(count(orders.where("o_totalprice >= 150000"), "n_high"), count(orders.where("o_totalprice < 150000"), "n_low"), "o_custkey")


@query("j16_coverage_gap_fill", "SELECT doc_id, 'UNMAPPED' AS label, CAST(0 AS DOUBLE) AS score FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return match.fill_gaps(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"], {"label": F.lit("UNMAPPED"), "score": F.lit(0.0)})


@query(
    "j17_two_key_anti",
    """SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 25) AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_totalprice > 450000)""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    busy = table(spark, sf, "lineitem").where("l_quantity >= 25").select(F.col("l_orderkey").alias("o_orderkey"))
    big = orders.where("o_totalprice > 450000").select("o_custkey")
    return orders.join(busy, "o_orderkey", "left_anti").join(big, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query(
    "j18_leakage_scan",
    f"""WITH h AS (SELECT doc_id, text FROM documents WHERE doc_id % 5 = 0), k AS (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0)
    SELECT DISTINCT h.doc_id AS held_id, k.doc_id AS known_id, 'exact' AS kind FROM h JOIN k ON lower(trim(h.text)) = lower(trim(k.text)) WHERE trim(h.text) <> ''
    UNION ALL SELECT DISTINCT h.doc_id, k.doc_id, 'deep' FROM h JOIN k ON {_DEEP.format("h.text")} = {_DEEP.format("k.text")} WHERE {_DEEP.format("h.text")} <> ''""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return match.leakage(docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0"), "doc_id", "text", "doc_id", "text")


_KEYWORDS = [("steel", "metal", 1), ("polished", "finish", 2), ("polished steel", "both", 3), ("brass", "metal", 4), ("ro", "short", 5), ("promo", "offer", 6), ("economy", "offer", 7), ("an", "short", 8), ("rod", "short", 9)]


@query(
    "j19_longest_keyword",
    f"""WITH w(word, label, seq) AS (VALUES {", ".join(f"('{w}', '{x}', {n})" for w, x, n in _KEYWORDS)})
    SELECT p_partkey, word, label FROM part JOIN w ON contains(lower(p_type || ' ' || p_name), word) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(word) DESC, seq) = 1""",
)
def _(spark, sf):
    words = spark.createDataFrame(_KEYWORDS, "word string, label string, seq int")
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("t"))
    return match.longest_keyword(part, "p_partkey", "t", words).select("p_partkey", "word", "label")


@query(
    "j20_keyword_tokens",
    f"""WITH w(word, label, seq) AS (VALUES {", ".join(f"('{w}', '{x}', {n})" for w, x, n in _KEYWORDS)})
    SELECT p_partkey, word FROM part JOIN w ON CASE WHEN length(word) <= 3 THEN lower(p_name || '/' || p_type) = word OR list_contains(regexp_split_to_array(lower(p_name || '/' || p_type), '[^a-z0-9]+'), word) ELSE contains(lower(p_name || '/' || p_type), word) END""",
)
def _(spark, sf):
    words = spark.createDataFrame(_KEYWORDS, "word string, label string, seq int")
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_type").alias("t"))
    return match.keyword_hits(part, "t", words).select("p_partkey", "word")


@query("j22_overlap_split", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AS urgent FROM customer")
def _(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    both, rest = match.overlap(table(spark, sf, "customer").select("c_custkey"), urgent, ["c_custkey"])
    return both.withColumn("urgent", F.lit(True)).unionAll(rest.withColumn("urgent", F.lit(False)))


@query(
    "j23_unmatched_first",
    """SELECT o_custkey, min(o_orderkey) AS first_order FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    left = orders.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return ranking.first_by(left, ["o_custkey"], F.col("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("j28_upsert", "SELECT coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey, coalesce(nullif(trim(a.name), ''), b.name) AS name FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS name FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_nationkey, 'new ' || n_name AS name FROM nation WHERE n_nationkey >= 10) b ON a.n_nationkey = b.n_nationkey")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    old = nation.where("n_nationkey < 20").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("name"))
    return match.upsert(old, nation.where("n_nationkey >= 10").select("n_nationkey", F.concat(F.lit("new "), "n_name").alias("name")), ["n_nationkey"], ["name"])


@query("j31_insert_absent", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey % 2 <> 0")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return match.insert_absent(s.where("s_suppkey % 2 = 0"), s.withColumn("s_name", F.lit("new")), ["s_suppkey"])


# Aggregations --------------------------------------------------------------------------------------------------------


@query("a01_group_summary", "SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 25) AS n_flag, count(DISTINCT p_type) AS n_distinct, min(p_name) AS first_value, round(100.0 * count(*) FILTER (p_size > 25) / count(*), 1) AS share FROM part GROUP BY p_brand")
def _(spark, sf):
    return profile.group_summary(table(spark, sf, "part"), "p_brand", F.col("p_size") > 25, "p_type", "p_name")


@query("a02_global_stats", "SELECT count(*) AS n, count(*) FILTER (p_size > 25) AS n_large, count(DISTINCT p_brand) AS n_brands, count(DISTINCT p_type) AS n_types, min(p_size) AS least, max(p_size) AS most FROM part")
def _(spark, sf):
    return table(spark, sf, "part").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("n_large"), F.count_distinct("p_brand").alias("n_brands"), F.count_distinct("p_type").alias("n_types"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


@query("a03_structure_check", "SELECT o_orderkey, bool_or(l_returnflag = 'R') AS has_returned, bool_or(l_linenumber = 1) AS has_first, count(DISTINCT l_linenumber) = max(l_linenumber) AS gapless FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(spark, sf):
    """Lines are summed up before the join: a row an order on either side. An order without lines has nulls, as the SQL's count of 0 equals no maximum."""
    orders, lines = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    rows = lines.count() + orders.count()
    orders, lines = dealt(orders, rows, "o_orderkey"), dealt(lines, rows, "l_orderkey")
    checked = lines.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("has_returned"), F.bool_or(F.col("l_linenumber") == 1).alias("has_first"), (F.count_distinct("l_linenumber") == F.max("l_linenumber")).alias("gapless"))
    return orders.distinct().join(checked, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("a04_counts_by_source", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("a05_profile", "SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS n_brands, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands, round(avg(p_size), 4) AS mean_size FROM part GROUP BY p_type")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_brands"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"), F.round(F.avg("p_size"), 4).alias("mean_size"))


_MODE = """WITH c AS (SELECT {k}, {v}, count(*) AS n FROM {t} GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY {k}) AS total, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, {v}) AS r FROM c)
    SELECT {k}, {v}, n, CAST(total AS BIGINT) AS total FROM t WHERE r = 1 AND n / total >= {s}"""


@query("a06_stable_mode", _MODE.format(k="l_orderkey", v="l_linestatus", t="lineitem", s=0.8))
def _(spark, sf):
    return profile.stable_mode(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linestatus").select("l_orderkey", "l_linestatus", "n", "total")


@query("a06_language_of_source", _MODE.format(k="source", v="lang", t="documents", s=0.6))
def _(spark, sf):
    return profile.stable_mode(table(spark, sf, "documents"), ["source"], "lang", 0.6).select("source", "lang", "n", "total")


@query(
    "a07_prefix_mode",
    """WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS r FROM c),
    s AS (SELECT left(CAST(l_orderkey AS VARCHAR), 2) AS prefix, l_returnflag, count(*) AS n FROM t WHERE r = 1 AND n / total >= 0.8 GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY prefix) AS total, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, l_returnflag) AS r FROM s)
    SELECT prefix, l_returnflag, n, CAST(total AS BIGINT) AS total FROM u WHERE r = 1 AND n / total >= 0.5""",
)
def _(spark, sf):
    return profile.prefix_mode(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", prefix_share=0.5).select("prefix", "l_returnflag", "n", "total")


@query(
    "a08_disambiguation",
    """WITH m AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1), c AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (FROM m) GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey, o_orderstatus) AS total, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY n DESC, o_orderpriority) AS r FROM c)
    SELECT o_custkey, o_orderstatus, o_orderpriority, n FROM t WHERE r = 1 AND n / total >= 0.8""",
)
def _(spark, sf):
    return profile.disambiguation(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority").select("o_custkey", "o_orderstatus", "o_orderpriority", "n")


@query(
    "a09_first_n_distinct",
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY ALL) SELECT user_id, event_type, place, row_number() OVER (PARTITION BY user_id ORDER BY place, event_type) AS rank FROM f QUALIFY rank <= 3""",
)
def _(spark, sf):
    return ranking.ordered_distinct(table(spark, sf, "events"), ["user_id"], "event_id", "event_type", 3).select("user_id", "event_type", "place", F.col("rank").cast("long").alias("rank"))


@query("a10_ratio_flag", "SELECT l_orderkey, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS ratio, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) >= 0.9")
def _(spark, sf):
    return profile.flagged_groups(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R").select("l_orderkey", F.round("ratio", 6).alias("ratio"), "n")


@query(
    "a11_fragmented_groups",
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_values, round(max(n) / sum(n), 6) AS top_share FROM c GROUP BY o_custkey HAVING sum(n) >= 3 AND count(*) > 2 AND max(n) / sum(n) < 0.5""",
)
def _(spark, sf):
    return profile.fragmented_groups(table(spark, sf, "orders"), "o_custkey", "o_orderpriority").select("o_custkey", "n", "n_values", F.round("top_share", 6).alias("top_share"))


@query("a12_orphans", "SELECT p_name, p_brand, p_type FROM part GROUP BY ALL HAVING count(*) = 1")
def _(spark, sf):
    return profile.orphans(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query("a13_multi_source", "SELECT p_name, p_type, count(DISTINCT p_brand) AS n_sources, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS sources FROM part GROUP BY p_name, p_type HAVING count(DISTINCT p_brand) > 1")
def _(spark, sf):
    return profile.multi_source(table(spark, sf, "part"), ["p_name", "p_type"], "p_brand")


@query("a14_row_checks", "SELECT count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (length(c_name) > 18) AS long_name, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')) AS other_segment FROM customer")
def _(spark, sf):
    from weftline.operators.evaluate import quality_counters

    return quality_counters(table(spark, sf, "customer"), {"negative": F.col("c_acctbal") < 0, "long_name": F.length("c_name") > 18, "other_segment": ~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")})


@query("a15_extra_assignments", "SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS extra, count(*) FILTER (k > 1) AS n_keys FROM (SELECT p_brand, p_type, count(DISTINCT lower(p_name)) AS k FROM part GROUP BY ALL)")
def _(spark, sf):
    return profile.extra_assignments(table(spark, sf, "part"), ["p_brand", "p_type"], "p_name")


@query(
    "a16_priority_ratio",
    """WITH b AS (SELECT o_custkey, min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END) AS best FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (best >= 1) AS n_worst, round(count(*) FILTER (best >= 1) / count(*), 4) AS ratio FROM b""",
)
def _(spark, sf):
    return profile.priority_ratio(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", {"F": 0, "O": 1, "P": 2}, 1)


@query(
    "a17_score_bins",
    """WITH b AS (SELECT l_orderkey, max(l_discount * 10) AS best FROM lineitem GROUP BY 1) SELECT CASE WHEN best >= 0.9 THEN '0.9+' WHEN best >= 0.7 THEN '0.7-0.9' WHEN best >= 0.5 THEN '0.5-0.7' ELSE '<0.5' END AS bin, count(*) AS n FROM b GROUP BY 1""",
)
def _(spark, sf):
    return profile.score_bins(table(spark, sf, "lineitem").withColumn("s", F.col("l_discount") * 10), "l_orderkey", "s")


@query("a22_batch_summary", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean, round(count(*) / (SELECT count(*) FROM events), 6) AS rate FROM events GROUP BY event_type")
def _(spark, sf):
    by = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean"))
    whole = by.agg(F.sum("n").alias("all_"))
    return by.crossJoin(whole).select("event_type", "n", "users", "mean", F.round(F.col("n") / F.col("all_"), 6).alias("rate"))  # a few types by one row


@query("a24_ordered_string_agg", "WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS o FROM part GROUP BY ALL) SELECT p_brand, string_agg(p_type, ';\n' ORDER BY o) AS text, count(*) AS n FROM f GROUP BY p_brand")
def _(spark, sf):
    return spec.ordered_strings(table(spark, sf, "part"), ["p_brand"], "p_type", "p_partkey")


@query(
    "a25_nested_agg",
    """WITH i AS (SELECT r_name, n_name, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) SELECT r_name, string_agg(n_name || ': ' || v, '; ' ORDER BY n_name) AS text FROM i GROUP BY r_name""",
)
def _(spark, sf):
    supplier, nation, region = (table(spark, sf, n) for n in ("supplier", "nation", "region"))
    both = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return spec.nested_strings(both, ["r_name"], "n_name", "s_name")


@query("a27_supp_rows", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, min(l_orderkey) AS first_order, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) AS first_flag FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts"), F.min("l_orderkey").alias("first_order"), F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("first_flag"))


@query(
    "a31_source_sets",
    """WITH e AS (SELECT trim(unnest(string_split(p_type || '|' || p_brand, '|'))) AS domain, p_size FROM part) SELECT domain, string_agg(DISTINCT CAST(p_size AS VARCHAR), ', ' ORDER BY CAST(p_size AS VARCHAR)) AS sources, count(DISTINCT p_size) AS n FROM e WHERE domain <> '' GROUP BY domain""",
)
def _(spark, sf):
    return spec.source_sets(table(spark, sf, "part").withColumn("d", F.concat_ws("|", "p_type", "p_brand")), "d", "p_size")


@query("a32_any_flag", "SELECT l_partkey, bool_or(l_tax > 0.07) AS flagged FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_tax") > 0.07).alias("flagged"))


@query("a33_worst_severity", "SELECT o_custkey, CASE max(CASE WHEN o_orderpriority LIKE '1%' THEN 2 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS worst, count(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, sf):
    severity = F.when(F.col("o_orderpriority").like("1%"), "error").when(F.col("o_orderpriority").like("2%"), "warning").otherwise("info")
    return profile.severities(table(spark, sf, "orders").withColumn("severity", severity), "o_custkey", "severity")


@query("a35_boilerplate", "WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(*) AS n_docs FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(*) >= 3")
def _(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return profile.boilerplate_lines(lines, "doc_id", "line")


@query(
    "a37_interval_union",
    """WITH i AS (SELECT user_id, epoch(ts) AS s, epoch(ts) + 3600 * 6 AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i),
    g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m), u AS (SELECT user_id, island, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)
    SELECT user_id, count(*) AS n, round(sum(e - s), 3) AS seconds FROM u GROUP BY user_id""",
)
def _(spark, sf):
    spans = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("s")).withColumn("e", F.col("s") + 3600 * 6)
    merged = intervals.interval_union(spans, ["user_id"], "s", "e")
    return merged.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))


# Ranking -------------------------------------------------------------------------------------------------------------


@query("w01_best_per_key", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def _(spark, sf):
    return ranking.best_scored(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], "l_extendedprice", "l_linenumber")


@query("w02_best_per_four_keys", "SELECT l_returnflag, l_linestatus, l_suppkey, l_linenumber, l_orderkey, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_suppkey, l_linenumber ORDER BY l_discount DESC, l_orderkey) = 1")
def _(spark, sf):
    keys = ["l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber"]
    lines = table(spark, sf, "lineitem").groupBy(*keys, "l_discount").agg(F.min("l_orderkey").alias("l_orderkey"))
    return ranking.best_scored(lines, keys, "l_discount", "l_orderkey").select(*keys, "l_orderkey", "l_discount")


@query("w03_best_keeps_place", "SELECT o_custkey, o_orderkey, o_totalprice, min(o_orderkey) OVER (PARTITION BY o_custkey) AS place FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(spark, sf):
    return ranking.best_keep_place(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("w04_latest_write", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(spark, sf):
    return ranking.latest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("w06_source_priority", "SELECT p_name, p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_partkey) = 1")
def _(spark, sf):
    part = table(spark, sf, "part").withColumn("priority", F.when(F.col("p_size") > 25, 0).otherwise(1))
    return ranking.prefer_source(part, ["p_name"], "priority", "p_partkey").select("p_name", "p_partkey", "p_brand")


@query("w07_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query("w08_first_substring_matches", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey QUALIFY row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) <= 5")
def _(spark, sf):
    both = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ranking.top_by(both, ["r_regionkey"], 5, F.col("n_nationkey")).select("r_regionkey", "n_nationkey")


@query("w10_three_key_sort", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_name, p_retailprice DESC, p_partkey) AS place FROM part")
def _(spark, sf):
    w = ranking.Window.partitionBy("p_brand").orderBy("p_type", "p_name", F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("w13_unique_labels", "SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS label FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)")
def _(spark, sf):
    return ranking.unique_labels(table(spark, sf, "part"), "p_brand", "p_name", "p_partkey", "label").select("p_partkey", "label")


@query("w14_round_robin", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents")
def _(spark, sf):
    return ranking.round_robin(table(spark, sf, "documents"), "lang", F.col("doc_id")).select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


@query("w19_next_start", "SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS last_id FROM events")
def _(spark, sf):
    return ranking.next_start(table(spark, sf, "events"), ["user_id"], "event_id", "last_id").select("user_id", "event_id", "last_id")


@query("w20_running_context", "SELECT conv_id, turn, coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def _(spark, sf):
    return ranking.running_context(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", 15).select("conv_id", "turn", F.array_join("context", ">").alias("context"))


@query("w21_nearest_rank", "SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY event_type")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"))


# Sets ----------------------------------------------------------------------------------------------------------------


@query("u01_union_aligned", "SELECT c_custkey AS key, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return sets.union_aligned(c, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")))


@query("u03_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, sf):
    return sets.union_distinct(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("u04_key_difference", "SELECT k, 'left' AS side FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT k, 'right' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return sets.key_difference(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), ["k"])


@query("u05_shared_variants", "WITH v AS (SELECT p_partkey, lower(p_name) AS variant FROM part UNION SELECT p_partkey, lower(p_brand || ' ' || p_name) FROM part) SELECT variant, count(DISTINCT p_partkey) AS n_ids, min(p_partkey) AS first_id FROM v GROUP BY variant HAVING count(DISTINCT p_partkey) > 1")
def _(spark, sf):
    return sets.shared_variants(table(spark, sf, "part"), "p_partkey", [F.lower("p_name"), F.lower(F.concat_ws(" ", "p_brand", "p_name"))])


@query("u06_same_ids", "WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS shared, count(*) FILTER (a.k IS NULL OR b.k IS NULL) = 0 AS equal_sets FROM a FULL JOIN b ON a.k = b.k")
def _(spark, sf):
    return sets.same_ids(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("u07_ordered_union", "SELECT p_partkey, array_to_string(list_distinct_ordered, ' ') AS words FROM (SELECT p_partkey, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT p_partkey, list_concat(string_split(p_name, ' '), string_split(p_type, ' ')) AS w FROM part))")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(sets.ordered_union(F.split("p_name", " "), F.split("p_type", " ")), " ").alias("words"))
