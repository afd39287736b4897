"""Tables behind workbooks: form extracts, chunks of standards, aggregated cells, update plans, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import blank, chunk, mask
from weftline.operators.ranking import first_by


def form_extract(fields: DataFrame, forms: DataFrame, kind: str, hidden: str, form: str, wanted: str = "variable", no: str = "No") -> DataFrame:
    """Visible fields of one kind with the names of their forms; forms that aren't there leave null."""
    shown = fields.where((F.trim(kind) == wanted) & (F.trim(hidden) == no))
    return shown.join(forms.dropDuplicates([form]), form, "left")


def standard_chunks(variables: DataFrame, datasets: DataFrame) -> DataFrame:
    """A text chunk for each variable with its dataset's label; variables (dataset, variable, label, role), datasets (dataset, dataset_label)."""
    both = variables.join(datasets, "dataset", "left")
    parts = [("Dataset", F.concat_ws(" - ", "dataset", "dataset_label")), ("Variable", F.col("variable")), ("Label", F.col("label")), ("Role", F.col("role"))]
    return both.select(F.concat_ws(".", "dataset", "variable").alias("chunk_id"), chunk(parts).alias("chunk_text")).where("chunk_text is not null")


def enriched(kb: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Records with the keywords of their key joined behind the text."""
    joined = words.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("word")), ", ").alias("keywords"))
    return kb.join(joined, key, "left").withColumn("text", F.concat_ws(" | ", "text", "keywords"))


def standard_json(datasets: DataFrame, variables: DataFrame, key: str) -> DataFrame:
    """A row for each dataset on either side with its variables in order (order, variable)."""
    by = variables.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "variable"))), lambda v: v["variable"]).alias("variables"))
    return datasets.join(by, key, "full")


def first_sources(rows: DataFrame, keys: list[str], value: str, seq: str, source: str) -> DataFrame:
    """The first source of each (key, value)."""
    return rows.groupBy(*keys, value).agg(F.min_by(source, seq).alias(source))


def joined_values(rows: DataFrame, keys: list[str], value: str, separator: str) -> DataFrame:
    """The sorted distinct values of each key; one value stands alone."""
    return rows.where(F.trim(blank(F.col(value))) != "").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias("text"))


def parents(rows: DataFrame, names: DataFrame, name: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Of the names without one of the endings the longest that is there."""
    stripped = F.filter(F.array(*[F.when(F.col(name).endswith(s), F.expr(f"substring({name}, 1, length({name}) - {len(s)})")) for s in suffixes]), lambda x: x.isNotNull() & (x != ""))
    each = rows.select(name, F.explode(stripped).alias("parent"))
    hit = each.join(names.select(F.col(name).alias("parent")).distinct(), "parent")
    return first_by(hit, [name], F.length("parent").desc(), F.col("parent"))


def near_table(a: Column, b: Column) -> Column:
    """Names that are equal or hold each other, whatever their case; blanks match nothing."""
    x, y = F.lower(F.trim(blank(a))), F.lower(F.trim(blank(b)))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def near_tables(df: DataFrame, names: DataFrame, column: str, name: str, most: int = 10_000) -> DataFrame:
    """J29 as a join with the list of known tables, which is broadcast and refused over ``most`` rows."""
    if names.limit(most + 1).count() > most:
        raise ValueError(f"lists of tables are broadcast and may have {most} rows at most")
    return df.join(F.broadcast(names), near_table(F.col(column), F.col(name)))


def update_plan(updates: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Updates with whether their cell is there: written or skipped."""
    there = cells.select(*keys).distinct().withColumn("__c", F.lit(1))
    return updates.join(there, keys, "left").withColumn("outcome", F.when(F.col("__c").isNull(), "skipped").otherwise("written")).drop("__c")


def last_writer(cells: DataFrame) -> DataFrame:
    """The net cell of each (sheet, row, col): later steps overwrite earlier ones. cells: sheet, row, col, step, seq, value."""
    return first_by(cells, ["sheet", "row", "col"], F.col("step").desc(), F.col("seq").desc())


def cell_style(score: Column, source: Column, status: Column) -> Column:
    """The style class of a result cell: status before source before score band."""
    band = F.when(score >= 0.9, "score_high").when(score >= 0.7, "score_medium").otherwise("score_low")
    return F.when(blank(status).isin("var_diff", "domain_diff", "ai_only", "ref_only"), status).when(source == "UNMAPPED", "unmapped").otherwise(band)


def report_rows(metrics: DataFrame) -> DataFrame:
    """Markdown table rows of (metric, base, now, passed), in order of the metric."""
    mark = F.when(F.col("passed"), "pass").otherwise("FAIL")
    return metrics.select("metric", F.concat(F.lit("| "), F.concat_ws(" | ", "metric", F.col("base").cast("string"), F.coalesce(F.col("now").cast("string"), F.lit("-")), mark), F.lit(" |")).alias("line"))


def manifest_issues(rows: DataFrame, required: tuple[str, ...], allowed: tuple[str, ...]) -> DataFrame:
    """Columns that are missing or not allowed, and rows with a blank required field: issue, n."""
    names = rows.columns
    fixed = [("missing:" + c) for c in required if c not in names] + [("unknown:" + c) for c in names if c not in allowed]
    blanks = [F.struct(F.lit("blank:" + c).alias("issue"), F.count_if(F.trim(blank(F.col(c))) == "").alias("n")) for c in required if c in names]
    out = [F.struct(F.lit(x).alias("issue"), F.lit(1).cast("long").alias("n")) for x in fixed]
    return rows.agg(F.array(*blanks, *out).alias("i")).select(F.inline("i")).where("n > 0")


def session_chunks(rows: DataFrame, source_file: str, seq: str, extra: tuple[str, ...] = ("annotation_variable", "metadata_table", "SDTM_Domain", "SDTM_Variable")) -> DataFrame:
    """A masked chunk (chunk_id, chunk_text, source_ref, row_index) for each row of an uploaded sheet: table, variable and what else is filled.

    Required columns are found whatever their case; without them there are no chunks. Row numbers come from ``seq``.
    """
    lower = {c.lower(): c for c in reversed(rows.columns)}
    need = ("annotation_table", "metadata_variable")
    schema = "chunk_id string, chunk_text string, source_ref string, row_index long"
    if not all(c in lower for c in need):
        return rows.sparkSession.createDataFrame([], schema)
    said = lambda label, c: F.when(~F.lower(F.trim(blank(F.col(c)))).isin("", "nan", "none"), F.concat(F.lit(f"{label}: "), F.trim(blank(F.col(c)))))
    parts = [said("表", lower[need[0]]), said("变量", lower[need[1]]), *[said(c, c) for c in extra if c in rows.columns]]
    ref = F.substring(F.sha2(F.lit(source_file), 256), 1, 16)
    text = F.concat_ws(" | ", *parts)
    out = rows.select(F.concat_ws("_", ref, F.col(seq).cast("string")).alias("chunk_id"), mask(text).alias("chunk_text"), ref.alias("source_ref"), F.col(seq).cast("long").alias("row_index"))
    return out.where("chunk_text <> ''")


def failures(recommendations: DataFrame, issues: DataFrame) -> DataFrame:
    """n_failed distinct (table, variable) that fell back or are pending, and n_errors distinct issues of severity error, in one row.

    recommendations: table_name, variable_name, sdtm_variable, source; issues: severity and any fields.
    """
    target = blank(F.col("sdtm_variable"))
    failed = (F.upper(blank(F.col("source"))) == "FALLBACK") | F.upper(target).endswith("_PENDING")
    name = F.coalesce(F.nullif(F.col("variable_name"), F.lit("")), F.nullif(target, F.lit("")), F.lit("unknown"))
    one = recommendations.agg(F.count_distinct(F.when(failed, F.struct(blank(F.col("table_name")), name))).alias("n_failed"))
    two = issues.where(F.lower(blank(F.col("severity"))) == "error").agg(F.count_distinct(F.struct("*")).alias("n_errors"))
    return one.crossJoin(two)  # one row by one row


def allowed_metrics(metrics: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """of a table of metrics the columns that may be reported."""
    return metrics.select(*[c for c in allowed if c in metrics.columns])
