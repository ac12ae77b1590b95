import pytest
from fixtures import doc, docx, pdf, png, xls, xlsx, zipped

from docweave.sources import archives, images
from docweave.sources import docx as docx_
from docweave.sources import pdf as pdf_
from docweave.sources import xlsx as xlsx_

PAGES = ["Hello world on page 1. More text (in brackets).", "Second page with amount 500000.", "Final page of the document."]
ROWS = [["name", "amount"], ["A", 100], ["B", 200], ["total", 300]]


def test_xlsx_cells():
    found = list(xlsx_.cells(xlsx({"Data": ROWS})))
    assert len(found) == 8 and found[7].ref == "B4" and found[7].number == 300
    assert "Data!B4: 300" in xlsx_.full_text(found)
    assert list(xlsx_.merged_ranges(xlsx({"Data": ROWS}, {"Data": ["A1:B1"]}))) == [("Data", "A1:B1")] and xlsx_.sheet_names(xlsx({"a": [], "b": ROWS})) == ["a", "b"]


def test_xlsx_skips_empty_and_keeps_kinds():
    found = list(xlsx_.cells(xlsx({"a": [["", True, 1.5]], "b": [["x"]]})))
    assert [(c.sheet, c.ref, c.kind, c.text) for c in found] == [("a", "B1", "boolean", "true"), ("a", "C1", "number", "1.5"), ("b", "A1", "string", "x")]


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_text(compress):
    assert [t for _, _, t in pdf_.pages(pdf(PAGES, compress))] == PAGES


def test_pdf_selects_pages_before_it_reads_them():
    assert [n for n, _, _ in pdf_.pages(pdf([f"page {k}" for k in range(1, 16)]), pdf_.select_pages)] == [*range(1, 8), 13, 14, 15]
    assert [t for _, _, t in pdf_.pages(pdf(["", ""]))] == ["", ""]


def test_pdf_refuses_others():
    with pytest.raises(pdf_.NoPdf):
        list(pdf_.pages(b"nothing"))


def test_docx_text():
    assert docx_.raw_text(docx(["One", "Two", "Three"])) == "One\n\nTwo\n\nThree"


def test_archive_entries():
    found = [(n, d) for n, d, _ in archives.entries(zipped({"b.md": "b", "a.txt": "a", "__MACOSX/a.txt": "", "x/.DS_Store": "", "Thumbs.db": ""}))]
    assert found == [("a.txt", b"a"), ("b.md", b"b")]


def test_a_large_entry_fails_alone():
    found = {n: (d, e) for n, d, e in archives.entries(zipped({"a.txt": "x" * 100, "b.txt": "small"}), max_bytes=50)}
    assert found["b.txt"] == (b"small", None) and found["a.txt"][0] is None and "too large" in found["a.txt"][1]


@pytest.mark.parametrize("name", ["../x.md", "/x.md", "a..b.txt"])
def test_archive_refuses_names_that_leave(name):
    with pytest.raises(archives.UnsafeEntry):
        list(archives.entries(zipped({"ok.md": "x", name: "y"})))


def test_image_sizes():
    assert images.size(png(64, 32)) == (64, 32, 1)
    assert images.fitted(4000, 1000) == (2000, 500) and images.fitted(64, 32) == (64, 32) and images.fitted(4000, 1000, 6) == (500, 2000)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.pdf").write_bytes(pdf(PAGES))
    (d / "b.xlsx").write_bytes(xlsx({"Data": ROWS}))
    (d / "c.docx").write_bytes(docx(["One", "Two", "Three"]))
    (d / "d.zip").write_bytes(zipped({"in.md": "# inside", "n.pdf": pdf(["text in an archive, long enough"])}))
    (d / "e.doc").write_bytes(b"not-a-real-doc")
    (d / "f.png").write_bytes(png(64, 32))
    (d / "g.bin").write_bytes(b"?")
    (d / "h.zip").write_bytes(zipped({"../x.md": "y"}))
    return d


def test_extract(spark, folder):
    from docweave.plans.engine import DocEngine

    rows = {r["path"].rpartition("/")[2]: r for r in DocEngine(spark).extract([*(str(p) for p in sorted(folder.iterdir())), str(folder / "no.pdf")]).collect()}
    assert len(rows) == 10
    assert rows["a.pdf"]["markdown"].startswith("# a.pdf\n\n## Page 1\n\nHello world on page 1.")
    assert "| A | B |\n| --- | --- |\n| name | amount |\n| A | 100 |" in rows["b.xlsx"]["markdown"]
    assert rows["c.docx"]["markdown"] == "# c.docx\n\nOne\n\nTwo\n\nThree\n"
    assert rows["d.zip!in.md"]["markdown"] == "# inside" and rows["d.zip!n.pdf"]["ok"]
    assert rows["f.png"]["markdown"] == "# f.png\n\n## Page 1\n\n[mock-ocr] recognized text\n"
    assert {k: r["error_code"] for k, r in rows.items() if not r["ok"]} == {"e.doc": "ERR_UNSUPPORTED_FORMAT", "g.bin": "ERR_UNSUPPORTED_FORMAT", "h.zip": "ERR_UNSUPPORTED_FORMAT", "no.pdf": "ERR_FILE_NOT_FOUND"}


def test_table_functions(spark, folder):
    from docweave.sources.scan import binary_files, register

    register(spark)
    binary_files(spark, str(folder), pattern="*.zip").where("path like '%d.zip'").createOrReplaceTempView("zips")
    assert [r["entry"] for r in spark.sql("SELECT e.entry FROM zips, LATERAL zip_entries(content) e ORDER BY 1").collect()] == ["in.md", "n.pdf"]
    binary_files(spark, str(folder / "a.pdf")).createOrReplaceTempView("pdfs")
    assert spark.sql("SELECT p.page_no FROM pdfs, LATERAL pdf_pages(content, false) p").count() == 3
    assert spark.read.format("xlsx_cells").load(str(folder / "b.xlsx")).count() == 8


def test_structure_with_cache(spark, tmp_path):
    from docweave.config import resolve
    from docweave.plans.engine import DocEngine

    engine = DocEngine(spark, resolve({}, cache_dir=str(tmp_path / "cache"), max_input_chars=1500))
    sources = spark.createDataFrame([("j", k, f"s{k}", "x" * 1000) for k in range(3)], "job string, seq int, name string, text string")
    for _ in range(2):
        answered = engine.structure(sources)
        assert answered.count() == 3 and {(r["k"], r["v"]) for r in engine.fields(answered).collect()} == {("mockField", "mock")}
    assert spark.read.parquet(str(tmp_path / "cache" / "answers")).count() == 3


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """The driver has no list of the files, a task has its share of them; names, lengths and hashes are those of Spark's own reader."""
    from pyspark.sql import functions as F

    from docweave.sources.scan import TASK_FILES, binary_files, listed

    for k in range(40):
        (tmp_path / f"f{k}.txt").write_bytes(b"x" * k)
    for name in (".hidden.txt", "_hidden.txt", "a b!.zip"):
        (tmp_path / name).write_bytes(b"y")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "f.txt").write_bytes(b"z")
    found = binary_files(spark, str(tmp_path))
    plain = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length", "content", F.sha2("content", 256).alias("file_hash"))
    assert sorted(found.where("length > 0").collect()) == sorted(plain.collect()) and found.count() == 41  # Spark passes over empty files
    assert not found.inputFiles() or not any(f.endswith(".txt") for f in found.inputFiles())
    assert 1 < found.rdd.getNumPartitions() <= 40 and TASK_FILES > 1
    names = {r["path"].rsplit("/", 1)[1] for r in listed(spark, str(tmp_path), pattern="{*[!tT],*[!xX][tT]}").collect()}
    assert names == {"a b!.zip"}
    assert {r["path"] for r in listed(spark, f"{tmp_path}/f1?.txt").collect()} == {f"file:{tmp_path}/f{k}.txt" for k in range(10, 20)}
    assert [r["length"] for r in listed(spark, str(tmp_path / "f7.txt")).collect()] == [7]
    (tmp_path / "none").mkdir()
    assert binary_files(spark, str(tmp_path / "none")).count() == 0


def test_many_files_are_one_batch(spark, tmp_path):
    """Parts of small files go on together."""
    from docweave.sources.scan import binary_files, parse_files

    for k in range(64):
        (tmp_path / f"f{k}.txt").write_bytes(b"x" * k)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    parts = parse_files(binary_files(spark, str(tmp_path)).coalesce(1))
    assert [r["n"] for r in parts.mapInArrow(sizes, "n long").collect()] == [64] and sorted(len(r["text"]) for r in parts.collect()) == list(range(64))


def test_files_are_opened_where_they_are_parsed(spark, tmp_path, monkeypatch):
    """Contents never go from worker to worker in batches: a worker makes and writes a file, or opens and parses it. The parts are those of contents that were read before."""
    from pyspark.sql.classic.dataframe import DataFrame

    from docweave.plans.all_queries import QUERIES
    from docweave.sources.scan import binary_files, dealt, parse_files, scan_files

    for name, content in (("a.pdf", pdf(PAGES)), ("b c.docx", docx(["One", "Two"])), ("d%.txt", b"text"), ("e.pdf", b"no pdf"), ("f.bin", b"?"), ("g.txt", b"")):
        (tmp_path / name).write_bytes(content)
    rows = lambda found: sorted(map(tuple, parse_files(found).drop("ms").collect()), key=str)
    assert rows(dealt(spark, str(tmp_path))) == rows(binary_files(spark, str(tmp_path))) and len(rows(dealt(spark, str(tmp_path)))) == 8
    (tmp_path / "h.zip").write_bytes(zipped({"in.md": "# inside"}))
    (tmp_path / "i.zip").write_bytes(zipped({"../x.md": "y"}))
    named = scan_files(spark, str(tmp_path), contents=False)
    assert rows(named) == rows(scan_files(spark, str(tmp_path))) and named.where("content is not null").count() == 1
    schemas = []
    own = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema, *a, **b: schemas.append(schema) or own(self, f, schema, *a, **b))
    found = QUERIES["pdf_scan_limits"](spark, "/root/testdata/sf0.001")
    assert len(schemas) == 3 and not any("content binary" in s for s in schemas)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    schemas.clear()
    QUERIES["pdf_results"](spark, "/root/testdata/sf0.001")
    assert schemas and not any("content binary" in s for s in schemas)


def test_images_are_decoded_by_tasks(spark, tmp_path, monkeypatch):
    """Usual PNGs never reach the source whose driver lists them; what is none goes there, in rounds."""
    from docweave.sources import images
    from docweave.sources.writers import png

    for k in range(6):
        (tmp_path / f"f{k}.png").write_bytes(png(20 + k, 10))
    asked = []
    by_spark = images._by_spark
    monkeypatch.setattr(images, "_by_spark", lambda *a, **b: asked.append(a[1]) or by_spark(*a, **b))
    sizes = lambda: sorted((r["path"].rsplit("/", 1)[1], r["width"], r["height"]) for r in images.decoded(spark, str(tmp_path), edge=22).collect())
    want = [(f"f{k}.png", *images.fitted(20 + k, 10, 1, 22)) for k in range(6)]
    assert sizes() == want and not asked
    monkeypatch.setattr(images, "ROUND", 2)
    monkeypatch.setattr(images, "png_pixels", lambda content: None)
    for name in ("no.png", "odd.jpg"):
        (tmp_path / name).write_bytes(b"no image")
    assert sizes() == want


@pytest.mark.parametrize("mb", [0, 6, 8, 17])
def test_large_compound_files(mb):
    """From 7 MB on the sectors of the table are more than the head has room for; from 15 MB on their list has several sectors."""
    from docweave.sources.ole import Compound, compound

    data = bytes(range(251)) * (mb * (1 << 20) // 251) + b"end"
    assert Compound(compound({"Workbook": data, "Other": b"x" * 5000})).stream("Workbook")[: len(data)] == data


def test_large_xls():
    from docweave.sources import xls as xls_

    rows = {name: [[k, f"{name} customer {k:030}", k % 7, k % 2 == 0] for k in range(30_000)] for name in ("A", "B", "C")}
    found = list(xls_.cells(xls_.xls(rows)))
    assert len(found) == 3 * 4 * 30_000 and found[-1].ref == "D30000" and found[-3].text == f"C customer {29_999:030}"
