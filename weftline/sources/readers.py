"""Readers. Tabular formats are Spark's own; workbooks, YAML and PDFs go through optional libraries, on the executors where there are many files."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from weftline.functions.text import blank
from weftline.operators.ranking import first_by


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table by its suffix: parquet, json (records or lines), jsonl, csv, tsv, xlsx, yaml. None if it isn't there or can't be read."""
    suffix = PurePosixPath(path).suffix.lower()
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        if suffix == ".parquet":
            return reader.parquet(path)
        if suffix == ".jsonl":
            return reader.json(path)
        if suffix == ".json":
            return reader.option("multiLine", not _is_lines(spark, path)).json(path)
        if suffix in (".csv", ".tsv", ".txt"):
            return reader.option("header", True).option("sep", "," if suffix == ".csv" else "\t").csv(path)
        if suffix in (".xlsx", ".xlsm", ".xls"):
            return read_workbook(spark, path) if _there(spark, path) else None
        if suffix in (".yaml", ".yml"):
            return read_yaml(spark, path)
    except AnalysisException:
        return None
    raise ValueError(f"no reader for {suffix} files")


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _is_lines(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file has an object a line, as Spark writes them; else it is one document over its lines."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    return first is None or first.value.strip()[:1] == "{" and first.value.strip()[-1:] == "}"


def first_there(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first of several paths that can be read."""
    for path in paths:
        if (df := read_records(spark, path)) is not None:
            return df
    return None


def read_folder(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """All parquet files of a folder but those named, with the file's name in ``file``."""
    df = spark.read.option("mergeSchema", True).parquet(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.where(~F.col("file").isin(*exclude)) if exclude else df


def with_metadata(df: DataFrame, fields: dict[str, str], column: str = "metadata") -> DataFrame:
    """JSON fields of a metadata column as columns: name to JSON path; columns that are there already win."""
    for name, path in fields.items():
        value = F.get_json_object(column, path)
        df = df.withColumn(name, F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), value) if name in df.columns else value)
    return df


def resolve_aliases(df: DataFrame, wanted: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns under their logical names: the first alias that is there, exactly, else whatever its case, else as a
    spreadsheet letter. Optional columns that are missing are left out; missing required ones are an error that lists them."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    found: dict[str, str] = {}
    for name, aliases in wanted.items():
        for a in aliases:
            if a in df.columns:
                found[name] = a
            elif a.lower() in lower:
                found[name] = lower[a.lower()]
            elif a.isascii() and a.isalpha() and len(a) <= 2 and (at := letter_index(a)) < len(df.columns):
                found[name] = df.columns[at]
            if name in found:
                break
    if missing := [n for n in required if n not in found]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items()])


def letter_index(letters: str) -> int:
    """Column number from 0 of spreadsheet letters."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0, header: int = 0) -> DataFrame:
    """One sheet of one workbook as strings, with ``row_index``; needs openpyxl. Workbooks are single small files, read on the driver."""
    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("reading workbooks needs openpyxl")
    frame = pd.read_excel(path, sheet_name=sheet, header=header, dtype=str)
    frame.insert(0, "row_index", range(header + 2, header + 2 + len(frame)))
    return spark.createDataFrame(frame.where(frame.notna(), None), ", ".join(["row_index long", *[f"`{c}` string" for c in frame.columns[1:]]]))


def sheet_names(path: str) -> list[str]:
    """Sheets of a workbook, those with rows first."""
    book = pd.read_excel(path, sheet_name=None, header=None, nrows=2)
    return sorted(book, key=lambda n: book[n].empty)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A YAML list of mappings; needs PyYAML."""
    if importlib.util.find_spec("yaml") is None:
        raise RuntimeError("reading YAML needs PyYAML")
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path).collect())  # one configuration file
    return spark.createDataFrame(pd.json_normalize(yaml.safe_load(text)).astype(str))


def pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of PDFs with their page and place, a task for each share of the files; needs pdfplumber."""
    if importlib.util.find_spec("pdfplumber") is None:
        raise RuntimeError("reading PDFs needs pdfplumber")

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pdfplumber

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    for number, page in enumerate(pdf.pages, 1):
                        rows = [(name, number, x["text"], x["x0"], x["top"], x["x1"], x["bottom"]) for x in page.extract_text_lines()]
                        yield pd.DataFrame(rows, columns=["path", "page", "text", "x0", "top", "x1", "bottom"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "path string, page int, text string, x0 double, top double, x1 double, bottom double")


def nested_outputs(df: DataFrame, recommendations: str = "recommendations", originals: str | None = None, name: str = "variable_name", original_name: str = "metadata_variable") -> DataFrame:
    """Nested tables of recommendations as rows; flat input stays as it is.

    originals: an array of the mappings that a table came from. Each recommendation gets the fields of the first one whose
    ``original_name`` is its ``name``, as original_..., and ``matched``, which is false where there is none.
    """
    if recommendations not in df.columns:
        return df
    keep = [c for c in df.columns if c not in (recommendations, originals)]
    rows = df.select(*keep, *([originals] if originals else []), F.explode_outer(recommendations).alias("__r"))
    if not originals:
        return rows.select(*keep, "__r.*")
    said = F.coalesce(F.col("__r")[name].cast("string"), F.lit(""))
    first = F.get(F.filter(originals, lambda o: F.coalesce(o[original_name].cast("string"), F.lit("")) == said), F.lit(0))
    fields = [f.name for f in df.schema[originals].dataType.elementType.fields]
    with_first = rows.withColumn("__o", first)
    return with_first.select(*keep, "__r.*", *[F.col("__o")[f].alias(f"original_{f}") for f in fields], F.col("__o").isNotNull().alias("matched"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a truth table that are blank or repeat; it must be empty."""
    some_blank = F.lit(False)
    for k in keys:
        some_blank = some_blank | (F.trim(blank(F.col(k))) == "")
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | some_blank)


def checked_truth(df: DataFrame, keys: list[str]) -> DataFrame:
    """S15 as a check: the truth table, or an error that names a key that is blank or repeats."""
    bad = duplicate_keys(df, keys).first()
    if bad is not None:
        raise ValueError(f"truth keys must be filled and unique: {tuple(bad[k] for k in keys)} stands {bad['n']} times")
    return df


def checkpoint(spark: SparkSession, base: str, model: str | None = None, context: str | None = None) -> DataFrame | None:
    """The recommendations of the first checkpoint that is there and fits: ``base.tmp.json``, ``base.json``, ``base.xlsx``; None without one.

    The temporary file is one object with model_name, checkpoint_context and recommendations; it only counts if both are those
    asked for (a bare list has no identity and doesn't count if a model is asked for). Rows: table_name and the fields of
    each recommendation; tables or variables without a name are left out.
    """
    for suffix in (".tmp.json", ".json", ".xlsx"):
        found = read_records(spark, base + suffix)
        if found is None:
            continue
        if suffix == ".xlsx":
            names = {"table_name": ["表", "Metadata Table"], "variable_name": ["变量", "Metadata Variable"], "domain": ["SDTM_Domain", "SDTM Domain"], "sdtm_variable": ["SDTM_Variable", "Representative Variable"], "score": ["Score"], "priority": ["Priority"]}
            rows = resolve_aliases(found, names, ("table_name", "variable_name"))
        else:
            if suffix == ".tmp.json":
                head = found.first()
                if "recommendations" in found.columns:
                    if model and ("model_name" not in found.columns or head["model_name"] != model):
                        continue
                    if context is not None and ("checkpoint_context" not in found.columns or head["checkpoint_context"] != context):
                        continue
                    found = found.select(F.inline("recommendations"))
                elif model:
                    continue
            if not {"table_name", "domain_recommendations"} <= set(found.columns):
                continue
            rows = found.select("table_name", F.inline("domain_recommendations"))
        filled = (F.trim(blank(F.col("table_name"))) != "") & (F.trim(blank(F.col("variable_name"))) != "")
        return rows.where(filled)
    return None


#: Variables that every domain has, which the older catalogue leaves out, and the category of a class of domains.
COMMON_VARIABLES = ("STUDYID", "DOMAIN", "USUBJID")
CATEGORIES = {"Interventions": "safety", "Events": "safety", "Findings": "laboratory", "Findings About": "laboratory", "Associated Persons": "safety"}


def catalogue(spark: SparkSession, first: list[str], older: list[str], otherwise: DataFrame) -> DataFrame:
    """Domain, category, variable, label (seq in order) of the first file of ``first`` that can be read, else of ``older``, else ``otherwise``.

    first: rows of domain, class, variable, label, seq. older: domain, variable, label, seq without a class; blanks and the
    variables that every domain has are left out, and of repeated ones the first stays. otherwise: domain, category, without variables.
    """
    if (df := first_there(spark, first)) is not None:
        pairs = [F.lit(x) for item in CATEGORIES.items() for x in item]
        return df.select("domain", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("class")), F.lit("other")).alias("category"), "variable", "label", "seq")
    if (df := first_there(spark, older)) is not None:
        rows = df.select(F.upper(F.trim("domain")).alias("domain"), F.trim("variable").alias("variable"), F.trim("label").alias("label"), "seq")
        rows = rows.where((F.col("domain") != "") & (F.col("variable") != "") & ~F.col("variable").isin(*COMMON_VARIABLES))
        kept = first_by(rows, ["domain", "variable"], F.col("seq"))
        return kept.join(otherwise.select("domain", "category"), "domain", "left").select("domain", F.coalesce("category", F.lit("other")).alias("category"), "variable", "label", "seq")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("variable", "string"), ("label", "string"), ("seq", "long"))]
    return otherwise.select("domain", "category", *nothing)


def kb_shape(columns: list[str]) -> str:
    """The kind of a knowledge file by its columns: structured chunks, mappings, or anything else."""
    have = {c.lower() for c in columns}
    if {"chunk_id", "chunk_text"} <= have:
        return "structured"
    if {"metadata_variable", "sdtm_variable"} <= have:
        return "mapping"
    return "generic"


def last_filled(*columns: str) -> Column:
    """The last filled of several columns."""
    return F.coalesce(*[F.nullif(F.trim(blank(F.col(c))), F.lit("")) for c in reversed(columns)])
