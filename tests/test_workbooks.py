"""Workbooks by hand: coordinates, kinds of cells, damaged files, and the plan of rows put in."""

import io
import tracemalloc
import zipfile

import pytest

from weftline.sources import workbooks as w

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def foreign(path):
    """A workbook as other programs write it: shared strings with runs, booleans, formulas, gaps, cells without places, an empty sheet."""
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{office}"><sheets><sheet name="Empty" sheetId="4" r:id="x1"/><sheet name="Da&amp;ta" sheetId="9" r:id="x2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="x2" Target="/xl/worksheets/b.xml"/><Relationship Id="x1" Target="worksheets/a.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>Name</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>')
        book.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        book.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="AA2"><f>1+1</f><v>2</v></c></row><row><c t="b"><v>1</v></c><c t="str"><v>x</v></c><c r="E3" s="1"/></row></sheetData></worksheet>')


def test_cells_of_a_foreign_workbook(spark, tmp_path):
    foreign(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    (tmp_path / "c.txt").write_text("not asked for")
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as book:
        book.writestr("word/document.xml", "<x/>")
    rows = w.read_cells(spark, str(tmp_path)).collect()
    assert sorted((r.sheet, r.row, r.col, r.kind, r.value) for r in rows if r.file == "a.xlsx" and r.row) == [("Da&ta", 2, 2, "text", "Name"), ("Da&ta", 2, 3, "text", "two runs"), ("Da&ta", 2, 27, "number", "2"), ("Da&ta", 3, 1, "boolean", "true"), ("Da&ta", 3, 2, "text", "x")]
    assert {r.file: r.error.split(":")[0] for r in rows if r.error} == {"b.xlsx": "BadZipFile", "d.xlsx": "KeyError"}
    cells = w.read_cells(spark, str(tmp_path))
    assert sorted((r.sheet, r.place, r.n) for r in w.sheets(cells).collect()) == [("Da&ta", 1, 5), ("Empty", 2, 0)]
    assert [(r.row, r.name, r.more) for r in w.sheet_rows(cells, {"name": ["Label", "Name"], "more": ["two runs"]}, 2).collect()] == [(3, "x", None)]
    assert [(r.sheet, r.missing) for r in w.missing_fields(cells, {"name": ["Name"], "q": ["Q"]}, ("name", "q"), 2).collect() if r.sheet != "Empty"] == [("Da&ta", "q")]


def test_written_workbooks_read_back(spark, tmp_path):
    values = ["plain", " blanks ", "<&>\"'", "line\nbreak", "体重", "ctrl\x01", "_x0041_"]
    rows = [("one.xlsx", "S", 3 + k, 2, v) for k, v in enumerate(values)] + [("two.xlsx", "B", 1, 703, "far"), ("two.xlsx", "A", 1, 1, None)]
    written = w.write_workbooks(spark.createDataFrame(rows, "file string, sheet string, row int, col int, value string"), f"file://{tmp_path}/books").collect()
    assert sorted((r.file, r.n) for r in written) == [("one.xlsx", 7), ("two.xlsx", 2)]
    found = w.read_cells(spark, f"{tmp_path}/books").collect()
    assert [r.value for r in sorted((r for r in found if r.file == "one.xlsx"), key=lambda r: r.row)] == [*values[:-1], "A"]
    assert {(r.sheet, r.col, r.value) for r in found if r.file == "two.xlsx"} == {("A", None, None), ("B", 703, "far")}


@pytest.mark.parametrize(("n", "letters"), [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")])
def test_letters(n, letters):
    assert w.column_letters(n) == letters and w.column_number(letters) == n


def test_rows_put_in_move_what_follows(spark):
    cells = spark.createDataFrame([("s", r, 1, f"v{r}") for r in range(1, 7)] + [("t", 2, 1, "x")], "sheet string, row int, col int, value string")
    inserts = spark.createDataFrame([("s", 2, 1, 1, "i1"), ("s", 2, 2, 1, "i2"), ("s", 2, 2, 2, "i2b"), ("s", 4, 1, 1, "i3"), ("u", 0, 1, 1, "first")], "sheet string, after int, seq int, col int, value string")
    updates = spark.createDataFrame([("s", 3, 1, "new3"), ("s", 5, 9, "fresh"), ("s", 1, 1, "a"), ("s", 1, 1, "b")], "sheet string, row int, col int, value string")
    found = sorted((r.sheet, r.row, r.col, r.value, r.origin) for r in w.writing_plan(cells, inserts, updates).collect())
    assert found == [
        ("s", 1, 1, "b", "updated"), ("s", 2, 1, "v2", "kept"), ("s", 3, 1, "i1", "inserted"), ("s", 4, 1, "i2", "inserted"), ("s", 4, 2, "i2b", "inserted"), ("s", 5, 1, "new3", "updated"), ("s", 6, 1, "v4", "kept"),
        ("s", 7, 1, "i3", "inserted"), ("s", 8, 1, "v5", "kept"), ("s", 8, 9, "fresh", "updated"), ("s", 9, 1, "v6", "kept"), ("t", 2, 1, "x", "kept"), ("u", 1, 1, "first", "inserted"),
    ]
    links = spark.createDataFrame([("s", 5, 1, "s", 2), ("t", 2, 1, "s", 6)], "sheet string, row int, col int, target string, target_row int")
    assert sorted(tuple(r) for r in w.moved_links(links, inserts).collect()) == [("s", 8, 1, "s", 2), ("t", 2, 1, "s", 9)]
    assert w.writing_plan(cells, inserts.limit(0), updates.limit(0)).count() == 7


def test_a_book_is_written_and_read_without_being_held():
    n = 60_000
    made = (("S", row, 1, f"text {row}") for row in range(1, n + 1))
    out = io.BytesIO()
    tracemalloc.start()
    assert w.write_book(out, made) == n
    assert sum(1 for _ in w.workbook_cells(out.getvalue())) == n
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3_000_000
