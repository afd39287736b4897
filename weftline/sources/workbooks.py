"""Workbooks (XLSX) read and written by tasks: Spark lists and deals the files, the standard library reads zip and XML.

A workbook becomes cells with their coordinates; sheets, header rows and aliases are joins over cells. A file that can't be
read is one row with the error, and all others are read. Dates are the numbers that the sheet stores.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import groupby, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import partitions

CELLS = "file string, sheet string, sheet_no int, row int, col int, kind string, value string, error string"
#: Names of the parts of a workbook, and the namespace of relations.
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
KINDS = {"s": "text", "inlineStr": "text", "str": "text", "b": "boolean", "e": "error", "n": "number", "d": "text"}
ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def column_number(letters: str) -> int:
    """Column number from 1 of spreadsheet letters."""
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _text(element: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic hints."""
    parts = []
    for child in element:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, int, str, str]]:
    """sheet, its number from 1, row, column (from 1), kind and value of each cell that has one; a sheet without any gives one row with nulls."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as part:
                for _, e in ElementTree.iterparse(part):
                    if _local(e.tag) == "si":
                        strings.append(_text(e))
                        e.clear()
        sheets = [s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        for number, sheet in enumerate(sheets, 1):
            target = targets[sheet.get(RELATION)]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names or "worksheets" not in path:
                continue  # a chart
            row = col = 0
            empty, table = True, None
            with book.open(path) as part:
                for event, e in ElementTree.iterparse(part, ("start", "end")):
                    tag = _local(e.tag)
                    if event == "start":
                        if tag == "row":
                            row, col = int(e.get("r") or row + 1), 0
                        elif tag == "sheetData":
                            table = e
                        continue
                    if tag == "c":
                        at = e.get("r")
                        col = column_number(at.rstrip("0123456789")) if at else col + 1
                        kind, value = e.get("t", "n"), None
                        for child in e:
                            if _local(child.tag) == "v":
                                value = child.text
                            elif _local(child.tag) == "is":
                                value = _text(child)
                        if value is not None and kind == "s":
                            value = strings[int(value)]
                        elif value is not None and kind == "b":
                            value = "true" if value == "1" else "false"
                        if value:
                            empty = False
                            yield sheet.get("name"), number, row, col, KINDS.get(kind, kind), value
                    elif tag == "row":
                        # The row and its place among the rows: a sheet's rows aren't held.
                        (e if table is None else table).clear()
            if empty:
                yield sheet.get("name"), number, None, None, None, None


def read_cells(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """All cells of all workbooks below ``path`` that ``pattern`` names.

    Columns: file, sheet, sheet_no, row, col (from 1), kind (text, number, boolean, error), value, error. Sheets without a value
    have one row with null coordinates; a file that can't be read has one row with its error and nothing else. Spark lists
    the files and deals them to tasks, so any store that it reads will do.
    """
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = [c.split()[0] for c in CELLS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = name.rpartition("/")[2]
                try:
                    # Read once to its end before anything of it is handed on, and not held.
                    for _ in workbook_cells(data):
                        pass
                    rows = ((name, *cell, None) for cell in workbook_cells(data))
                except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError, RuntimeError, NotImplementedError, EOFError) as e:
                    # What a damaged, foreign or protected file gives: it is that file's row.
                    rows = iter([(name, None, None, None, None, None, None, f"{type(e).__name__}: {e}")])
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(work, CELLS)


def sheets(cells: DataFrame) -> DataFrame:
    """File, sheet, place (from 1), n: the sheets of each file, those with values first, else in their order."""
    by = cells.where("error is null").groupBy("file", "sheet", "sheet_no").agg(F.count("value").alias("n"))
    place = F.row_number().over(Window.partitionBy("file").orderBy((F.col("n") == 0), "sheet_no"))
    return by.select("file", "sheet", place.alias("place"), "n")


def first_sheets(cells: DataFrame) -> DataFrame:
    """The cells of each file's first sheet with values."""
    return cells.join(sheets(cells).where("place = 1").select("file", "sheet"), ["file", "sheet"], "left_semi")


def fields(cells: DataFrame, wanted: dict[str, list[str]], header: int = 1) -> DataFrame:
    """file, sheet, field, col: the column of each wanted field in each sheet: of its aliases the first that stands in row ``header``, its leftmost one. Names are trimmed."""
    aliases = cells.sparkSession.createDataFrame([(f, a, k) for f, names in wanted.items() for k, a in enumerate(names)], "field string, name string, place int")
    heads = cells.where(F.col("row") == header).select("file", "sheet", "col", F.trim("value").alias("name"))
    found = heads.join(F.broadcast(aliases), "name").groupBy("file", "sheet", "field").agg(F.min(F.struct("place", "col")).alias("best"))
    return found.select("file", "sheet", "field", F.col("best.col").alias("col"))


def missing_fields(cells: DataFrame, wanted: dict[str, list[str]], required: tuple[str, ...], header: int = 1) -> DataFrame:
    """file, sheet, missing (names joined by commas) of the sheets that lack a required field."""
    asked = F.array(*map(F.lit, required))
    known = fields(cells, wanted, header).groupBy("file", "sheet").agg(F.collect_set("field").alias("there"))
    every = cells.where("error is null").select("file", "sheet").distinct()
    left = every.join(known, ["file", "sheet"], "left").withColumn("lacks", F.array_except(asked, F.coalesce("there", F.array().cast("array<string>"))))
    return left.where(F.size("lacks") > 0).select("file", "sheet", F.array_join("lacks", ",").alias("missing"))


def sheet_rows(cells: DataFrame, wanted: dict[str, list[str]], header: int = 1) -> DataFrame:
    """File, sheet, row and the wanted fields (trimmed strings, null if blank) of all rows below the header that have one of them.

    Each sheet's columns are found by its own header, so files may differ. A field that a sheet lacks is null there.
    """
    placed = cells.where(F.col("row") > header).join(fields(cells, wanted, header), ["file", "sheet", "col"])
    value = F.nullif(F.trim("value"), F.lit(""))
    by = placed.where(value.isNotNull()).groupBy("file", "sheet", "row")
    return by.agg(*[F.max(F.when(F.col("field") == f, value)).alias(f) for f in wanted])


def template_rows(cells: DataFrame, variable: list[str], definition: list[str], header: int = 13, length: int = 2) -> DataFrame:
    """File, sheet, row, col, variable, definition: of all sheets with names of ``length`` characters the rows with a variable, and the coordinates of their definition."""
    short = cells.where(F.length("sheet") == length)
    where = fields(short, {"definition": definition}, header).select("file", "sheet", F.col("col"))
    rows = sheet_rows(short, {"variable": variable, "definition": definition}, header).where("variable is not null")
    return rows.join(where, ["file", "sheet"]).select("file", "sheet", "row", "col", "variable", F.coalesce("definition", F.lit("")).alias("definition"))


def conversions(cells: DataFrame, wanted: dict[str, list[str]], required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows of each file's first sheet with values, and a report: file, n, error. A file that can't be read, has no value or lacks a required field is in the report only."""
    first = first_sheets(cells)
    lacks = missing_fields(first, wanted, required)
    good = first.join(lacks, ["file", "sheet"], "left_anti")
    rows = sheet_rows(good, wanted)
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))
    errors = cells.where("error is not null").select("file", "error").unionByName(lacks.select("file", F.concat(F.lit("missing columns: "), "missing").alias("error")))
    files = cells.select("file").distinct()
    report = files.join(counts, "file", "left").join(errors.groupBy("file").agg(F.min("error").alias("error")), "file", "left")
    return rows, report.select("file", F.coalesce("n", F.lit(0)).alias("n"), "error")


def write_book(stream, cells: Iterator[tuple[str, int, int, str | float | None]]) -> int:
    """Writes a workbook of cells (sheet, row, column, value), in the order of sheets and rows, as they come; returns how many: texts and numbers, no styles."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    names: list[str] = []
    total = 0
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as book:
        for sheet, own in groupby(cells, key=lambda c: c[0]):
            names.append(sheet)
            with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as part:
                part.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                at = None
                for _, row, col, value in own:
                    total += 1
                    if row != at:
                        part.write(("</row>" if at is not None else "").encode() + f'<row r="{row}">'.encode())
                        at = row
                    place = f"{column_letters(col)}{row}"
                    if isinstance(value, (int, float)):
                        part.write(f'<c r="{place}"><v>{value!r}</v></c>'.encode())
                    elif value is not None:
                        said = escape(ILLEGAL.sub(lambda m: f"_x{ord(m[0]):04X}_", value))
                        part.write(f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{said}</t></is></c>'.encode())
                part.write((b"</row>" if at is not None else b"") + b"</sheetData></worksheet>")
        n = range(1, len(names) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n)
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, names, strict=True)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
    return total


def write_workbooks(cells: DataFrame, path: str) -> DataFrame:
    """A workbook for each ``file`` below ``path``, of cells (file, sheet, row, col, value); returns file, n (cells), size in bytes, a row for each. Runs when its rows are read.

    A file's cells go to one task, which writes them as they come and holds none. Sheets come in the order of their names. Files are written under a
    name of their own and moved, so a repeated try leaves whole ones.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(path)
        files.create_dir(top, recursive=True)
        rows = (row for batch in batches for at in range(0, batch.num_rows, 10_000) for row in zip(*(c.to_pylist() for c in batch.slice(at, 10_000).columns), strict=True))
        for name, own in groupby(rows, key=lambda r: r[0]):
            with files.open_output_stream(f"{top}/.{name}.part") as stream:
                n = write_book(stream, (r[1:] for r in own))
            files.move(f"{top}/.{name}.part", f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([files.get_file_info(f"{top}/{name}").size])], names=["file", "n", "size"])

    dealt = cells.select("file", "sheet", "row", "col", "value").repartition(partitions(cells.sparkSession), "file").sortWithinPartitions("file", "sheet", "row", "col")
    return dealt.mapInArrow(work, "file string, n bigint, size bigint")


def write_files(contents: DataFrame, path: str) -> DataFrame:
    """Files (file, content binary) below ``path`` as they are; returns file and size. Runs when its rows are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(path)
        files.create_dir(top, recursive=True)
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_output_stream(f"{top}/.{name}.part") as stream:
                    stream.write(data)
                files.move(f"{top}/.{name}.part", f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())], names=["file", "size"])

    return contents.select("file", "content").mapInArrow(work, "file string, size bigint")


def writing_plan(cells: DataFrame, inserts: DataFrame, updates: DataFrame) -> DataFrame:
    """Where every cell stands once rows are put in: sheet, row, col, value, origin (kept, updated or inserted).

    cells: sheet, row, col, value; updates: sheet, row, col, value (of two for a cell the greater value counts); inserts: sheet, after,
    seq, col, value: the cells of new rows, which stand behind row ``after`` in the order of ``seq``. All coordinates are those of the
    sheet as it is. A row moves down by the number of new rows behind smaller ones: a running sum over the sheet's
    insert points, not over its cells. Updates of cells that aren't there come in as cells. A sheet has 1,048,576 rows at most.
    """
    rows = inserts.select("sheet", "after", "seq").distinct()
    points = rows.groupBy("sheet", "after").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sheet").orderBy("after").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    until = F.lead("after").over(Window.partitionBy("sheet").orderBy("after"))
    spans = points.withColumn("before", before).withColumn("until", until)
    new = rows.join(spans, ["sheet", "after"]).withColumn("k", F.row_number().over(Window.partitionBy("sheet", "after").orderBy("seq")))
    placed = inserts.join(new.select("sheet", "after", "seq", (F.col("after") + F.col("before") + F.col("k")).alias("row")), ["sheet", "after", "seq"])
    changed = updates.groupBy("sheet", "row", "col").agg(F.max("value").alias("new"))
    there = cells.join(changed.withColumn("hit", F.lit(True)), ["sheet", "row", "col"], "full")
    old = there.select("sheet", "row", "col", F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value"), F.when(F.col("hit"), "updated").otherwise("kept").alias("origin"))
    # A row lies in the span behind the last insert point before it: found by merging both in the order of rows, a sheet's at a time.
    marks = spans.select("sheet", F.col("after").alias("row"), F.lit(1).alias("kind"), (F.col("before") + F.col("n")).alias("shift"))
    lines = old.select("sheet", "row").distinct().select("sheet", "row", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("shift"))
    w = Window.partitionBy("sheet").orderBy("row", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = lines.unionByName(marks).withColumn("shift", F.coalesce(F.last("shift", ignorenulls=True).over(w), F.lit(0))).where("kind = 0").select("sheet", "row", "shift")
    kept = old.join(moved, ["sheet", "row"]).select("sheet", (F.col("row") + F.col("shift")).alias("row"), "col", "value", "origin")
    return kept.unionByName(placed.select("sheet", "row", "col", "value", F.lit("inserted").alias("origin")))


def moved_links(links: DataFrame, inserts: DataFrame) -> DataFrame:
    """Links (sheet, row, col, target, target_row) with both ends on the rows that they have once rows are put in."""

    def shifted(df: DataFrame, sheet: str, row: str) -> DataFrame:
        points = inserts.select(F.col("sheet").alias("__s"), F.col("after").alias("__after"), "seq").distinct().groupBy("__s", "__after").agg(F.count("*").alias("__n"))
        asked = df.select(F.col(sheet).alias("__s"), F.col(row).alias("__r")).distinct()
        w = Window.partitionBy("__s").orderBy("__r", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = asked.select("__s", "__r", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("__n")).unionByName(points.select("__s", F.col("__after").alias("__r"), F.lit(1).alias("kind"), "__n"))
        to = both.withColumn("__shift", F.sum("__n").over(w)).where("kind = 0").select("__s", "__r", "__shift")
        return df.join(to, (F.col(sheet) == F.col("__s")) & (F.col(row) == F.col("__r"))).withColumn(row, F.col(row) + F.col("__shift")).drop("__s", "__r", "__shift")

    return shifted(shifted(links, "sheet", "row"), "target", "target_row").select("sheet", "row", "col", "target", "target_row")
