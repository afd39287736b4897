"""Queries on workbooks: tables written as workbooks and read back by their cells, and the plan of rows put in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import forms
from weftline.session import shared_path, table
from weftline.sources import workbooks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Registers a query (spark, sf_dir) with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _cells(df, file, sheet, row, columns: dict):
    """Cells of a table: a header in the row above ``first`` of each sheet, and a row for each of ``df``."""
    body = F.inline(F.array(*[F.struct(F.lit(k + 1).alias("col"), c.cast("string").alias("value")) for k, c in enumerate(columns.values())]))
    return df.select(file.alias("file"), sheet.alias("sheet"), row.cast("int").alias("row"), body)


def _heads(df, at: int, names: list[str]):
    head = F.inline(F.array(*[F.struct(F.lit(k + 1).alias("col"), F.lit(n).alias("value")) for k, n in enumerate(names)]))
    return df.select("file", "sheet").distinct().select("file", "sheet", F.lit(at).alias("row"), head)


def _parts(spark, sf, header: int = 1):
    """The parts as workbooks, one for each type, with a sheet for each size class and an empty one in front."""
    part = table(spark, sf, "part")
    file, sheet = F.concat(F.lower("p_type"), F.lit(".xlsx")), F.concat(F.lit("S"), (F.col("p_size") % 3).cast("string"))
    columns = {"Key": F.col("p_partkey"), "Name ": F.concat(F.lit(" "), "p_name"), "Brand": F.when(F.col("p_size") % 5 > 0, F.col("p_brand"))}
    cells = _cells(part, file, sheet, F.col("p_partkey") + header + 1, columns)
    empty = cells.select("file").distinct().select("file", F.lit("A").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit(None).cast("string").alias("value"))
    path = shared_path(spark, "books")
    workbooks.write_workbooks(cells.unionByName(_heads(cells, header, list(columns))).unionByName(empty), path).write.format("noop").mode("overwrite").save()
    return path


_WANTED = {"key": ["No such", "Key"], "name": ["Name", "Label"], "brand": ["Brand"]}


@query("s05_workbook_rows", "SELECT lower(p_type) || '.xlsx' AS file, 'S' || p_size % 3 AS sheet, CAST(p_partkey + 2 AS INTEGER) AS row, CAST(p_partkey AS VARCHAR) AS key, p_name AS name, CASE WHEN p_size % 5 > 0 THEN p_brand END AS brand FROM part")
def _(spark, sf):
    """All rows of all sheets, under the names that their own headers give them."""
    return workbooks.sheet_rows(workbooks.read_cells(spark, _parts(spark, sf)), _WANTED)


@query("s06_template_rows", "SELECT lower(p_type) || '.xlsx' AS file, 'S' || p_size % 3 AS sheet, CAST(p_partkey + 14 AS INTEGER) AS row, 3 AS col, p_name AS variable, CASE WHEN p_size % 5 > 0 THEN p_brand ELSE '' END AS definition FROM part")
def _(spark, sf):
    """Rows below row 13 of sheets with names of two characters, with the coordinates of their definitions."""
    return workbooks.template_rows(workbooks.read_cells(spark, _parts(spark, sf, 13)), ["变量名称", "Name"], ["Brand"])


@query("s07_converted", "SELECT lower(p_type) || '.xlsx' AS file, p_name AS name, CASE WHEN p_size % 5 > 0 THEN p_brand END AS brand FROM part WHERE p_size % 3 = (SELECT min(q.p_size % 3) FROM part q WHERE q.p_type = part.p_type)")
def _(spark, sf):
    """The first sheet with values of each workbook, through JSON and Parquet as the converter writes them."""
    rows, _ = workbooks.conversions(workbooks.read_cells(spark, _parts(spark, sf)), _WANTED, ("key", "name"))
    out = shared_path(spark, "converted")
    rows.write.parquet(f"{out}/parquet")
    spark.read.parquet(f"{out}/parquet").write.json(f"{out}/json")
    return spark.read.schema("file string, name string, brand string").json(f"{out}/json")


@query("s08_isolated_failures", "SELECT lower(p_type) || '.xlsx' AS file, count(*) FILTER (p_size % 3 = s) AS n, CAST(NULL AS VARCHAR) AS error FROM part JOIN (SELECT p_type, min(p_size % 3) AS s FROM part GROUP BY 1) USING (p_type) GROUP BY 1 UNION ALL SELECT n_name || '.xlsx', 0, CASE WHEN n_nationkey % 2 = 0 THEN 'BadZipFile' ELSE 'missing columns: name' END FROM nation")
def _(spark, sf):
    """Good workbooks beside files that are none and workbooks without a required column: each has its row in the report."""
    path = _parts(spark, sf)
    nation = table(spark, sf, "nation")
    file = F.concat("n_name", F.lit(".xlsx"))
    odd = _cells(nation.where("n_nationkey % 2 = 1"), file, F.lit("S"), F.col("n_nationkey") + 2, {"Key": F.col("n_nationkey")})
    workbooks.write_workbooks(odd.unionByName(_heads(odd, 1, ["Key"])), path).write.format("noop").mode("overwrite").save()
    workbooks.write_files(nation.where("n_nationkey % 2 = 0").select(file.alias("file"), F.encode("n_name", "utf-8").alias("content")), path).write.format("noop").mode("overwrite").save()
    _, report = workbooks.conversions(workbooks.read_cells(spark, path), _WANTED, ("key", "name"))
    return report.select("file", "n", F.regexp_replace("error", "^BadZipFile.*", "BadZipFile").alias("error"))


@query("s09_sheets", "WITH s AS (SELECT p_type, p_size % 3 AS k, 3 + count(*) * 2 + count(*) FILTER (p_size % 5 > 0) AS n FROM part GROUP BY ALL) SELECT lower(p_type) || '.xlsx' AS file, 'S' || k AS sheet, CAST(row_number() OVER (PARTITION BY p_type ORDER BY k) AS INTEGER) AS place, n FROM s UNION ALL SELECT lower(p_type) || '.xlsx', 'A', CAST(count(*) + 1 AS INTEGER), 0 FROM s GROUP BY p_type")
def _(spark, sf):
    return workbooks.sheets(workbooks.read_cells(spark, _parts(spark, sf)))


_SHEETS = """c AS (SELECT o_custkey % 10 AS sheet, o_orderkey AS row, 1 AS col, o_orderstatus AS value FROM orders), i AS (SELECT l_suppkey % 10 AS sheet, l_orderkey AS after, l_partkey AS seq, 2 AS col, min(l_shipdate::DATE::VARCHAR) AS value FROM lineitem WHERE l_quantity = 3 GROUP BY ALL), u AS (SELECT o_custkey % 10 AS sheet, o_orderkey AS row, 1 AS col, 'new' AS value FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _plan(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    sheet = (F.col("o_custkey") % 10).alias("sheet")
    cells = orders.select(sheet, F.col("o_orderkey").alias("row"), F.lit(1).alias("col"), F.col("o_orderstatus").alias("value"))
    new = lines.where("l_quantity = 3").groupBy((F.col("l_suppkey") % 10).alias("sheet"), F.col("l_orderkey").alias("after"), F.col("l_partkey").alias("seq")).agg(F.min(F.col("l_shipdate").cast("date").cast("string")).alias("value")).withColumn("col", F.lit(2))
    changed = orders.where("o_orderpriority = '1-URGENT'").select(sheet, F.col("o_orderkey").alias("row"), F.lit(1).alias("col"), F.lit("new").alias("value"))
    return cells, new, changed


@query(
    "k08_writing_plan",
    f"""WITH {_SHEETS}, g AS (SELECT sheet, after, count(*) AS n FROM i GROUP BY sheet, after), n AS (SELECT sheet, after, n, coalesce(sum(n) OVER (PARTITION BY sheet ORDER BY after ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
    k AS (SELECT c.sheet, c.row + coalesce((n.before + n.n), 0) AS row, c.col, CASE WHEN u.value IS NULL THEN c.value ELSE u.value END AS value, CASE WHEN u.value IS NULL THEN 'kept' ELSE 'updated' END AS origin
      FROM (SELECT c.*, (SELECT max(after) FROM n WHERE n.sheet = c.sheet AND n.after < c.row) AS point FROM c) c LEFT JOIN n ON n.sheet = c.sheet AND n.after = point LEFT JOIN u ON u.sheet = c.sheet AND u.row = c.row)
    SELECT sheet, CAST(row AS BIGINT) AS row, col, value, origin FROM k UNION ALL SELECT sheet, CAST(after + before + row_number() OVER (PARTITION BY sheet, after ORDER BY seq) AS BIGINT), col, value, 'inserted' FROM i JOIN n USING (sheet, after)""",
)
def _(spark, sf):
    """Orders as the rows of ten sheets, with rows put in between and cells changed."""
    return workbooks.writing_plan(*_plan(spark, sf))


@query(
    "k08_moved_links",
    f"""WITH {_SHEETS}, a AS (SELECT sheet, after, count(*) AS n FROM i GROUP BY sheet, after), s AS (SELECT sheet, after, sum(n) OVER (PARTITION BY sheet ORDER BY after) AS total FROM a), l AS (SELECT sheet, row, (sheet + 1) % 10 AS target, row // 2 AS target_row FROM c WHERE row % 7 = 0)
    SELECT l.sheet, CAST(row + coalesce(x.total, 0) AS BIGINT) AS row, 1 AS col, target, CAST(target_row + coalesce(y.total, 0) AS BIGINT) AS target_row FROM (SELECT l.*, (SELECT max(after) FROM s WHERE s.sheet = l.sheet AND after < row) AS p, (SELECT max(after) FROM s WHERE s.sheet = l.target AND after < target_row) AS q FROM l) l
    LEFT JOIN s x ON x.sheet = l.sheet AND x.after = p LEFT JOIN s y ON y.sheet = l.target AND y.after = q""",
)
def _(spark, sf):
    cells, new, _ = _plan(spark, sf)
    links = cells.where("row % 7 = 0").select("sheet", "row", "col", ((F.col("sheet") + 1) % 10).alias("target"), F.floor(F.col("row") / 2).alias("target_row"))
    return workbooks.moved_links(links, new)


# Forms on pages ------------------------------------------------------------------------------------------------------


def _form_words(spark, sf):
    """A page for each brand: a title, a header of two lines with a column for each type, and a numbered row for each part."""
    part = table(spark, sf, "part")
    types = part.select("p_brand", "p_type").distinct().withColumn("k", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_type")))
    word = lambda line, top, x, text: F.struct(line.cast("int").alias("line"), top.cast("double").alias("top"), (top + 10).cast("double").alias("bottom"), F.lit(10.0).alias("size"), x.cast("double").alias("x0"), (x + 5 * F.length(text)).cast("double").alias("x1"), text.alias("text"))
    n = lambda v: F.lit(v)
    x = 60 + 120 * F.col("k")
    heads = types.select("p_brand", F.inline(F.array(word(n(2), n(60), x, F.col("p_type")), word(n(2), n(60), x + 5 * F.length("p_type") + 2, n("code")), word(n(3), n(72), x, n("value")))))
    fixed = part.select("p_brand").distinct().select("p_brand", F.inline(F.array(word(n(1), n(40), n(20), F.replace("p_brand", n("#"), n(""))), word(n(2), n(60), n(20), n("No.")))))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = part.withColumn("n", place).where("n <= 99").join(types, ["p_brand", "p_type"])
    body = rows.select("p_brand", F.inline(F.array(word(F.col("n") + 9, 80 + 12 * F.col("n"), n(20), F.col("n").cast("string")), word(F.col("n") + 9, 80 + 12 * F.col("n"), x, F.col("p_name")))))
    return fixed.unionByName(heads).unionByName(body)


@query("t46_page_tables", "SELECT p_brand, 0 AS grid, replace(p_brand, '#', '') AS title, string_agg(DISTINCT p_type || ' code value', ',' ORDER BY p_type || ' code value') AS columns, CAST(3 + least(99, count(*)) AS INTEGER) AS lines FROM part GROUP BY p_brand")
def _(spark, sf):
    found = forms.grids(_form_words(spark, sf), ["p_brand"])
    return found.select("p_brand", "grid", "title", F.array_join("columns", ",").alias("columns"), F.size("lines").alias("lines"))


@query(
    "t46_form_sections",
    """WITH t AS (SELECT DISTINCT p_brand, p_type || ' code value' AS field FROM part), s AS (SELECT p_brand, replace(p_brand, '#', '') AS title, field, row_number() OVER (PARTITION BY p_brand ORDER BY field) AS place FROM t)
    SELECT p_brand, 1 AS section, CAST(NULL AS VARCHAR) AS title, 1 AS place, 'Subject' AS field FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT p_brand, 2, title, place, field FROM s UNION ALL SELECT p_brand, 3, NULL, 1, 'Remarks' FROM (SELECT DISTINCT p_brand FROM part)""",
)
def _(spark, sf):
    """Labels before and after the table of each form: three sections."""
    found = forms.grids(_form_words(spark, sf).withColumn("page", F.lit(1)), ["p_brand", "page"])
    brands = table(spark, sf, "part").select("p_brand").distinct().withColumn("page", F.lit(1))
    labels = brands.select("p_brand", "page", F.inline(F.array(F.struct(F.lit(10.0).alias("top"), F.lit("Subject").alias("label")), F.struct(F.lit(9000.0).alias("top"), F.lit("Remarks").alias("label")), F.struct(F.lit(9100.0).alias("top"), F.lit("subject ").alias("label")))))
    return forms.sections(labels, found, "p_brand", "page")
