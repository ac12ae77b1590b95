"""Workbooks by sheets: partitions, filters, memory."""

import io
import json
import tracemalloc
import zipfile

import pytest
from fixtures import xlsx

from pyspark.sql import functions as F

from docweave.sources import xlsx as reader
from docweave.sources.scan import binary_files, parse_files, register

ROWS = [["name", "n"], *([f"row {k}", k] for k in range(30))]


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    register(spark)
    d = tmp_path_factory.mktemp("books")
    (d / "a.xlsx").write_bytes(xlsx({"First": ROWS, "Second": [["x", None, True]], "Third": ROWS[:3]}))
    return str(d / "a.xlsx")


def load(spark, book):
    return spark.read.format("xlsx_cells").load(book)


def test_a_sheet_is_a_partition(spark, book):
    found = load(spark, book)
    parts = parse_files(binary_files(spark, book)).where("kind = 'cell'")
    assert sorted(map(tuple, found.select("sheet", "ref", "value_type", "text", "formula").collect()), key=str) == sorted(map(tuple, parts.select("sheet", "ref", "value_type", "text", "formula").collect()), key=str)
    assert found.rdd.getNumPartitions() == 3
    assert spark.read.format("xlsx_cells").option("found", json.dumps([book, book])).load().count() == 2 * found.count()


def test_what_is_asked_for(spark, book):
    every = load(spark, book).collect()
    cases = [
        ({"sheets": '["Third"]'}, lambda r: r["sheet"] == "Third"), ({"columns": "B, C"}, lambda r: r["col_no"] in (2, 3)), ({"last_row": "3", "columns": "A"}, lambda r: r["row_no"] <= 3 and r["col_no"] == 1), ({"sheets": "[]"}, lambda r: False),
    ]
    for options, holds in cases:
        kept = spark.read.format("xlsx_cells").options(**options).load(book)
        assert sorted(map(tuple, kept.collect()), key=str) == sorted((tuple(r) for r in every if holds(r)), key=str)
    assert spark.read.format("xlsx_cells").option("sheets", '["Third"]').load(book).rdd.getNumPartitions() == 1
    found = load(spark, book)
    assert found.where("sheet = 'Third'").count() < found.count() == len(every)


def test_a_large_sheet_in_little_memory():
    """400,000 cells: a row at a time."""
    rows = "".join(f'<row r="{k}">' + "".join(f'<c r="{c}{k}"><v>{k}</v></c>' for c in "ABCDEFGH") + "</row>" for k in range(1, 50_001))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="s" r:id="i"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="i" Target="sheet.xml"/></R>')
        z.writestr("xl/sheet.xml", f"<worksheet><sheetData>{rows}</sheetData><mergeCells><mergeCell ref='A1:B1'/></mergeCells></worksheet>")
    content = out.getvalue()
    del rows
    tracemalloc.start()
    assert sum(1 for _ in reader.cells(content)) == 400_000 and list(reader.merged_ranges(content)) == [("s", "A1:B1")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20


def test_a_file_that_fails_late(spark, tmp_path):
    """After more parts than are held, the error comes last; the engine takes the file as failed."""
    good = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c></row>' for k in range(1, 25_001))
    for name, rows in (("late.xlsx", good + "<row r='x'>"), ("early.xlsx", "<row r='1'><c r='A1'><v>1</v></c></row><row r='x'>")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="s" r:id="i"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="i" Target="sheet.xml"/></R>')
            z.writestr("xl/sheet.xml", f"<worksheet><sheetData>{rows}")
    # the sheet of merged ranges is read before the cells and fails at once, so both files fail early
    parts = parse_files(binary_files(spark, str(tmp_path))).groupBy(F.regexp_extract("path", "([a-z]+).xlsx", 1).alias("f"), "kind").count().collect()
    assert sorted((r["f"], r["kind"], r["count"]) for r in parts) == [("early", "error", 1), ("late", "error", 1)]
