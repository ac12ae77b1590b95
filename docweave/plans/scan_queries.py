"""Queries that open files: a table's rows are written as files into the shared folder, which are then scanned like any others."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.config import resolve
from docweave.functions import files
from docweave.operators.archives import archive_summaries, classify_entries, input_slots
from docweave.operators.external import MockOcr
from docweave.plans.engine import DocEngine
from docweave.plans.file_queries import PAGES_SQL
from docweave.plans.registry import query, table
from docweave.sources.scan import ParseOptions, binary_files, dealt, images_of, listed, parse_files
from docweave.sources.store import discard, hadoop_path, shared_folder, write_file, written
from docweave.sources.zip_source import TASK_BYTES, archives_at, read_archives


def _made(rows: DataFrame, make: Callable[..., bytes], columns: list[str], name: Column) -> str:
    """A folder with a file for each row: name says its path in it, make its content from the columns' values. For few files."""
    return _made_in(rows, make, columns, name, 1)[0]


def _made_in(rows: DataFrame, make: Callable[..., bytes], columns: list[str], name: Column, n: int | None = None) -> list[str]:
    """As _made() for many files, dealt over n folders (four for each core) by their names: tasks that make files in one folder wait for each other, and one folder is listed by one task."""
    n = n or 4 * rows.sparkSession.sparkContext.defaultParallelism
    root = shared_folder(rows.sparkSession)
    folders = [f"{root}/{k}" for k in range(n)]
    for folder in folders:
        there, system = hadoop_path(rows.sparkSession, folder)
        system.mkdirs(there)

    def run(batches):
        """Makes and writes a file at a time, in one worker: contents do not wait for others, nor go through Spark."""
        import pyarrow as pa

        made_folders: set[str] = set()
        for batch in batches:
            for k in range(batch.num_rows):
                write_file(batch.column("path")[k].as_py(), make(*(batch.column(c)[k].as_py() for c in columns)), made_folders)
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    path = F.concat(F.lit(f"{root}/"), F.pmod(F.xxhash64(name), F.lit(n)).cast("string"), F.lit("/"), name)
    rows.select(path.alias("path"), *columns).mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
    return folders


def _put_together(rows: DataFrame, key: str, order: list[str], name: Column, writer: Callable) -> str:
    """A folder with a file for each key: its rows go in order through writer(stream).add(row), one at a time, so a file may be larger than memory. name says a file's path in the folder."""
    folder = shared_folder(rows.sparkSession)

    def run(batches):
        import uuid

        import pyarrow as pa

        from docweave.sources.sink import file_system

        class Whole:
            """A file under a hidden name until all of it is there."""

            def __init__(self, path: str):
                self.system, self.inner = file_system(path)
                at, self.path = self.inner.rpartition("/")[0], path
                self.hidden = f"{at}/.{uuid.uuid4().hex}"
                self.system.create_dir(at, recursive=True)
                self.stream = self.system.open_output_stream(self.hidden)
                self.writer = writer(self.stream)

            def finish(self):
                self.writer.close()
                self.stream.close()
                self.system.move(self.hidden, self.inner)
                return pa.RecordBatch.from_arrays([pa.array([self.path], pa.string())], ["path"])

        now = None
        for batch in batches:
            for row in chain.from_iterable(batch.slice(k, 64).to_pylist() for k in range(0, batch.num_rows, 64)):
                if now is None or now.path != row["__path"]:
                    if now is not None:
                        yield now.finish()
                    now = Whole(row["__path"])
                now.writer.add(row)
        if now is not None:
            yield now.finish()

    dealt = rows.withColumn("__path", F.concat(F.lit(f"{folder}/"), name)).repartition(key).sortWithinPartitions(key, "__path", *order)
    dealt.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
    return folder


def _spread(rows: DataFrame) -> DataFrame:
    """A table's rows over all cores: a few MB of rows, in one task as they are stored, make a million files. A part is a quarter of what a task reads of the table, at most."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, 4 * rows.rdd.getNumPartitions()))


def _id(path: str = "path", kind: str = "long") -> Column:
    """The number in a file's name."""
    return F.regexp_extract(F.regexp_replace(path, r"(?s)\.zip!(?!/).*$", ".zip"), r"([0-9]+)\.[^./]*$", 1).cast(kind)


def _named(key: str, ending: str) -> Column:
    return F.concat(F.lit("f"), F.col(key).cast("string"), F.lit(ending))


# Text files.


def _texts(spark: SparkSession, sf_dir: str) -> list[str]:
    return _made_in(_spread(table(spark, sf_dir, "documents").select("doc_id", "text")), lambda t: (t or "").encode(), ["text"], _named("doc_id", ".txt"))


@query("file_scan", "SELECT doc_id, concat('f', doc_id, '.txt') AS file_name, CAST(strlen(text) AS BIGINT) AS length, floor(CAST(strlen(text) AS DOUBLE) / 1048576 * 1000 + 0.5) / 1000 AS file_size_mb, sha256(text) AS file_hash FROM documents")
def file_scan(spark, sf_dir):
    found = binary_files(spark, *_texts(spark, sf_dir))
    return found.select(_id().alias("doc_id"), files.base_name(F.col("path")).alias("file_name"), "length", files.size_mb(F.col("length")).alias("file_size_mb"), "file_hash")


@query("text_scan", "SELECT doc_id, text, 'text' AS kind FROM documents")
def text_scan(spark, sf_dir):
    return parse_files(dealt(spark, *_texts(spark, sf_dir))).select(_id().alias("doc_id"), "text", "kind")


# Workbooks: one for each region, a sheet for each nation, a row for each customer.
SHEETS_SQL = """(SELECT n_regionkey AS region, n_name AS sheet, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, c.* FROM customer c JOIN nation ON n_nationkey = c_nationkey)"""
XLSX_SQL = f"""SELECT CAST(region AS BIGINT) AS region, sheet, concat(list_extract(['A', 'B', 'C', 'D'], k), r) AS ref, CASE k WHEN 2 THEN 'string' WHEN 4 THEN 'boolean' ELSE 'number' END AS value_type,
  CASE k WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN concat(c_name, ' & <', c_mktsegment, '>') WHEN 3 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) ELSE CASE WHEN c_acctbal > 5000 THEN 'true' ELSE 'false' END END AS value
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM {SHEETS_SQL}) WHERE k <> 3 OR c_acctbal > 0"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the workbooks; with their region and sheet."""
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return people.select("n_regionkey", "n_name", "c_custkey", F.concat("c_name", F.lit(" & <"), "c_mktsegment", F.lit(">")).alias("name"), F.floor("c_acctbal").alias("balance"), (F.col("c_acctbal") > 5000).alias("rich"), (F.col("c_acctbal") > 0).alias("shown"))


#: What puts the rows of a sheet in order; the first says it, the others only make it the same each time.
ROW_ORDER = ["c_custkey", "name", "balance", "rich", "shown"]


def _books(spark: SparkSession, sf_dir: str) -> str:
    """XLSX are written row by row."""

    class Book:
        def __init__(self, stream):
            from docweave.sources.writers import XlsxWriter

            self.book, self.close = (book := XlsxWriter(stream)), book.close

        def add(self, r):
            self.book.row(r["n_name"], [r["c_custkey"], r["name"], r["balance"] if r["shown"] else None, r["rich"]], ["A1:B1"])

    return _put_together(_people(spark, sf_dir), "n_regionkey", ["n_name", *ROW_ORDER], _named("n_regionkey", ".xlsx"), Book)


def _legacy_books(spark: SparkSession, sf_dir: str, most: int | None = None) -> str:
    """XLS are put together in memory, so it bounds them that a sheet has room for 65,536 rows (most): a nation's next ones are in the region's next book, b0f1.xls, b1f1.xls and so on."""
    from docweave.sources.xls import ROWS

    class Book:
        def __init__(self, stream):
            from docweave.sources.xls import XlsWriter

            self.book, self.close = (book := XlsWriter(stream)), book.close

        def add(self, r):
            self.book.row(r["n_name"], [r["c_custkey"], r["name"], r["balance"] if r["shown"] else None, r["rich"]], [(0, 0, 0, 1)])

    place = F.row_number().over(Window.partitionBy("n_regionkey", "n_name").orderBy(*ROW_ORDER)) - 1
    rows = _people(spark, sf_dir).withColumn("place", place).withColumn("name_of_book", F.concat(F.lit("b"), F.floor(F.col("place") / (most or ROWS)).cast("string"), _named("n_regionkey", ".xls")))
    return _put_together(rows, "name_of_book", ["n_name", "place"], F.col("name_of_book"), Book)


def _cells(spark, folder, ref: Column | None = None):
    parts = parse_files(dealt(spark, folder)).where("kind = 'cell'")
    return parts.select(_id().alias("region"), "sheet", (F.col("ref") if ref is None else ref).alias("ref"), "value_type", F.col("text").alias("value"))


@query("xlsx_scan", XLSX_SQL)
def xlsx_scan(spark, sf_dir):
    """Through the source whose partitions are sheets."""
    from docweave.sources.scan import register

    register(spark)
    paths = [r["path"] for r in listed(spark, _books(spark, sf_dir)).toLocalIterator()]
    found = spark.read.format("xlsx_cells").option("found", json.dumps(paths)).load()
    return found.select(_id().alias("region"), "sheet", "ref", "value_type", F.col("text").alias("value"))


@query("xlsx_parts", XLSX_SQL)
def xlsx_parts(spark, sf_dir):
    """As parts of files, which the engine reads."""
    return _cells(spark, _books(spark, sf_dir))


@query("xls_scan", XLSX_SQL)
def xls_scan(spark, sf_dir):
    """A cell's row is counted on through the books of its region."""
    return _legacy_cells(spark, sf_dir)


def _legacy_cells(spark, sf_dir, most: int | None = None):
    from docweave.sources.xls import ROWS

    before = F.regexp_extract("path", r"b([0-9]+)f[0-9]+\.xls$", 1).cast("long") * (most or ROWS)
    row = F.regexp_extract("ref", "[0-9]+$", 0).cast("long") + before
    return _cells(spark, _legacy_books(spark, sf_dir, most), F.concat(F.regexp_extract("ref", "^[A-Z]+", 0), row.cast("string")))


@query("xlsx_merged", "SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS region, n_name AS sheet, 'A1:B1' AS merged FROM nation JOIN customer ON n_nationkey = c_nationkey")
def xlsx_merged(spark, sf_dir):
    parts = parse_files(dealt(spark, _books(spark, sf_dir))).where("kind = 'merge'")
    return parts.select(_id().alias("region"), "sheet", F.col("ref").alias("merged"))


@query("xlsx_cells_function", f"SELECT region, sheet, count(*) AS n, count(*) FILTER (value_type = 'number') AS numbers FROM ({XLSX_SQL}) GROUP BY region, sheet")
def xlsx_cells_function(spark, sf_dir):
    from docweave.sources.scan import register

    register(spark)
    binary_files(spark, _books(spark, sf_dir)).createOrReplaceTempView("docweave_books")
    found = spark.sql("SELECT path, c.sheet, c.value_type FROM docweave_books, LATERAL xlsx_cells(content) c")
    return found.groupBy(_id().alias("region"), "sheet").agg(F.count("*").alias("n"), F.count_if(F.col("value_type") == "number").alias("numbers"))


# Documents: a paragraph for each line.
CUT_SQL = "(SELECT *, CASE WHEN length(body) > 5000 THEN concat(left(body, 3500), E'\\n\\n[... truncated ', length(body) - 5000, E' chars ...]\\n\\n', right(body, 1500)) ELSE body END AS cut FROM (SELECT *, trim(replace(text, chr(10), E'\\n\\n'), E' \\n\\t\\r') AS body FROM documents))"
SECTIONS_SQL = f"(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, p AS text FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS p FROM (SELECT doc_id, regexp_split_to_array(cut, '\\n\\s*\\n') AS l FROM {CUT_SQL})) WHERE trim(p, E' \\n\\t\\r') <> '')"


def _docx(spark: SparkSession, sf_dir: str) -> list[str]:
    def make(text) -> bytes:
        from docweave.sources.writers import docx

        return docx((text or "").split("\n"))

    return _made_in(_spread(table(spark, sf_dir, "documents").select("doc_id", "text")), make, ["text"], _named("doc_id", ".docx"))


@query("docx_scan", f"SELECT doc_id, body AS text, CAST(greatest(1, (length(body) + 499) // 500) AS INTEGER) AS page_count FROM {CUT_SQL}")
def docx_scan(spark, sf_dir):
    parts = parse_files(dealt(spark, *_docx(spark, sf_dir)))
    return parts.select(_id().alias("doc_id"), "text", files.page_count(F.char_length("text")).alias("page_count"))


@query("docx_results", f"SELECT s.doc_id, concat('p-', k) AS section_id, s.text, length(body) > 5000 AS truncated FROM {SECTIONS_SQL} s JOIN {CUT_SQL} c ON s.doc_id = c.doc_id")
def docx_results(spark, sf_dir):
    found = DocEngine(spark, resolve({})).results(_docx(spark, sf_dir), detect=False)
    return found.select(_id().alias("doc_id"), F.col("source.truncated").alias("truncated"), F.inline("raw.sections")).select("doc_id", "section_id", "text", "truncated")


@query("doc_scan", "SELECT conv_id, trim(string_agg(replace(text, chr(10), ' '), E'\\n\\n' ORDER BY turn), E' \\n\\t\\r') AS text FROM conversations GROUP BY conv_id")
def doc_scan(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")))).alias("turns"))

    def make(turns) -> bytes:
        from docweave.sources.doc import doc

        return doc([t["text"] for t in turns])

    return parse_files(dealt(spark, *_made_in(turns, make, ["turns"], _named("conv_id", ".doc")))).select(_id().alias("conv_id"), "text")


# PDFs: a page for each 500 characters.
PDF_SQL = f"(SELECT doc_id, p, n, trim(substr(text, CAST((p - 1) * 500 + 1 AS INTEGER), 500), E' \\n\\t\\r') AS t FROM (SELECT doc_id, text, {PAGES_SQL} AS n, unnest(range(1, {PAGES_SQL} + 1)) AS p FROM documents))"


def _pdfs(spark: SparkSession, sf_dir: str) -> list[str]:
    def make(text, n) -> bytes:
        from docweave.sources.writers import pdf

        return pdf([text[k * 500 : k * 500 + 500] for k in range(n)])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), files.page_count(F.col("n_chars")).alias("n"))
    return _made_in(_spread(docs), make, ["text", "n"], _named("doc_id", ".pdf"))


@query("pdf_scan", f"SELECT doc_id, CAST(p AS INTEGER) AS page_no, n AS page_count, t AS text FROM {PDF_SQL} WHERE n <= 10 OR p <= 7 OR p > n - 3")
def pdf_scan(spark, sf_dir):
    parts = parse_files(dealt(spark, *_pdfs(spark, sf_dir)))
    return parts.select(_id().alias("doc_id"), F.col("number").alias("page_no"), F.col("total").alias("page_count"), "text")


@query("pdf_scan_limits", f"SELECT doc_id, CAST(p AS INTEGER) AS page_no, n AS page_count FROM {PDF_SQL} WHERE n <= 4 OR p <= 2 OR p > n - 2")
def pdf_scan_limits(spark, sf_dir):
    parts = parse_files(dealt(spark, *_pdfs(spark, sf_dir)), ParseOptions(max_pages=4, page_ratio=(1, 1)))
    return parts.select(_id().alias("doc_id"), F.col("number").alias("page_no"), F.col("total").alias("page_count"))


@query("pdf_results", f"""SELECT doc_id, string_agg(concat('--- Page ', p, E' ---\\n', CASE WHEN length(t) < 20 THEN '[mock-ocr] recognized text' ELSE t END), E'\\n\\n' ORDER BY p) AS full_text, CAST(count(*) AS INTEGER) AS n_pages,
  max(n) > 10 AS truncated, count(*) FILTER (length(t) < 20) AS images FROM {PDF_SQL} WHERE n <= 10 OR p <= 7 OR p > n - 3 GROUP BY doc_id""")
def pdf_results(spark, sf_dir):
    found = DocEngine(spark, resolve({})).results(_pdfs(spark, sf_dir), detect=False)
    return found.select(_id().alias("doc_id"), F.col("raw.full_text").alias("full_text"), F.size("raw.pages").alias("n_pages"), F.col("source.truncated").alias("truncated"), F.col("metrics.performance.images").alias("images"))


# Scanned pages: each supplier's PDF has a page with a text and one without; the model says the same of every page.
SAID = "Paid in full 【印章:ACME | 红色 | 圆形】 and 【签名:J. Doe】 again 【印章:未知|蓝】"
SAID_SQL = "'Paid in full 【印章:ACME | 红色 | 圆形】 and 【签名:J. Doe】 again 【印章:未知|蓝】'"


def _scans(spark: SparkSession, sf_dir: str) -> list[str]:
    def make(name) -> bytes:
        from docweave.sources.writers import pdf

        return pdf([f"This page says enough about {name}.", "", "short"])

    return _made_in(_spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")), make, ["s_name"], _named("s_suppkey", ".pdf"))


def _seen(spark: SparkSession, folders: list[str], detect: bool, **given) -> DataFrame:
    return DocEngine(spark, resolve({}, **given), ocr=MockOcr(reply=SAID)).results(folders, detect=detect)


@query("ocr_pages", f"SELECT s_suppkey, CAST(p AS INTEGER) AS page_no, CASE p WHEN 1 THEN concat('This page says enough about ', s_name, '.') ELSE {SAID_SQL} END AS text FROM (SELECT *, unnest([1, 2, 3]) AS p FROM supplier)")
def ocr_pages(spark, sf_dir):
    found = _seen(spark, _scans(spark, sf_dir), False)
    return found.select(_id().alias("s_suppkey"), F.explode("raw.pages").alias("p")).select("s_suppkey", "p.page_no", "p.text")


@query("ocr_seals", "SELECT s_suppkey, concat('seal-p', p, '-', k) AS seal_id, CASE k WHEN 1 THEN 'ACME' END AS owner, CASE k WHEN 1 THEN 'red' ELSE 'blue' END AS color, CASE k WHEN 1 THEN 'circle' END AS shape, 'pdf-bbox' AS locator_kind, CAST(p AS INTEGER) AS page_no, CAST(0.7 AS DOUBLE) AS confidence FROM (SELECT *, unnest([1, 2]) AS k FROM (SELECT *, unnest([1, 2, 3]) AS p FROM supplier))")
def ocr_seals(spark, sf_dir):
    found = _seen(spark, _scans(spark, sf_dir), True)
    return found.select(_id().alias("s_suppkey"), F.inline("raw.seals")).select("s_suppkey", "seal_id", "owner", "color", "shape", "locator_kind", "page_no", "confidence")


@query("ocr_calls", "SELECT s_suppkey, CAST(3 AS BIGINT) AS images, CAST(6 AS BIGINT) AS seals, CAST(3 AS BIGINT) AS signatures, CAST(3 AS BIGINT) AS calls, CAST(0 AS DOUBLE) AS total_yuan, false AS cache_hit FROM supplier")
def ocr_calls(spark, sf_dir):
    found = _seen(spark, _scans(spark, sf_dir), True)
    m = F.col("metrics")
    return found.select(_id().alias("s_suppkey"), m["performance"]["images"].alias("images"), m["quality"]["seals"].alias("seals"), m["quality"]["signatures"].alias("signatures"), m["cost"]["calls_by_model"]["mock-ocr"]["calls"].alias("calls"), m["cost"]["total_yuan"].alias("total_yuan"), m["performance"]["cache_hit"].alias("cache_hit"))


@query("ocr_seals_off", "SELECT s_suppkey, CAST(2 AS BIGINT) AS images, true AS no_seals FROM supplier")
def ocr_seals_off(spark, sf_dir):
    """The configuration's word counts more than the call's."""
    found = _seen(spark, _scans(spark, sf_dir), True, detect_seals=False)
    return found.select(_id().alias("s_suppkey"), F.col("metrics.performance.images").alias("images"), F.col("raw.seals").isNull().alias("no_seals"))


@query("cached_texts", f"SELECT doc_id, sha256(text) AS text_hash, CAST(length(text) AS BIGINT) AS n_chars, text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) AS cache_hit FROM documents")
def cached_texts(spark, sf_dir):
    """All texts, of which an earlier run has kept those of some; what is kept is found by content, under any name."""
    from docweave.plans.engine import DocEngine

    engine = DocEngine(spark, resolve({}, mode="mock", cache_dir=shared_folder(spark)))
    scanned, begun = engine.scan(_texts(spark, sf_dir)), written()
    engine.parsed(scanned.where(_id() % 3 == 0)).write.format("noop").mode("overwrite").save()
    discard(spark, begun, written())  # of the earlier run only the cache stays
    found = engine.parsed(scanned)
    return found.select(_id().alias("doc_id"), F.sha2(F.col("raw.full_text").cast("binary"), 256).alias("text_hash"), F.char_length("raw.full_text").cast("long").alias("n_chars"), "cache_hit")


@query("cached_results", "SELECT s_suppkey, true AS first_ok, true AS cache_hit, CAST(0 AS BIGINT) AS total_ms FROM supplier")
def cached_results(spark, sf_dir):
    folders, cache = _scans(spark, sf_dir), shared_folder(spark)
    first = _seen(spark, folders, True, cache_dir=cache).select("path", F.col("ok").alias("first_ok"))
    again = _seen(spark, folders, True, cache_dir=cache)
    both = again.select("path", F.col("metrics.performance.cache_hit").alias("cache_hit"), F.col("metrics.performance.total_ms").alias("total_ms")).join(first, "path")
    return both.select(_id().alias("s_suppkey"), "first_ok", "cache_hit", "total_ms")


# Images: one for each part, of a size that goes by its key.
IMAGE_SQL = "(SELECT p_partkey, 20 + p_partkey % 41 AS w, 10 + p_partkey % 53 AS h FROM part)"


def _pictures(spark: SparkSession, sf_dir: str) -> list[str]:
    def make(w, h) -> bytes:
        from docweave.sources.writers import png

        return png(w, h)

    parts = table(spark, sf_dir, "part").select("p_partkey", (20 + F.col("p_partkey") % 41).cast("int").alias("w"), (10 + F.col("p_partkey") % 53).cast("int").alias("h"))
    return _made_in(_spread(parts), make, ["w", "h"], _named("p_partkey", ".png"))


@query("image_scan", f"SELECT p_partkey, concat(CAST(greatest(1, floor(w * s + 0.5)) AS INTEGER), 'x', CAST(greatest(1, floor(h * s + 0.5)) AS INTEGER)) AS size, 'image/png' AS mime FROM (SELECT *, least(1::DOUBLE, 40::DOUBLE / greatest(w, h)) AS s FROM {IMAGE_SQL})")
def image_scan(spark, sf_dir):
    parts = parse_files(dealt(spark, *_pictures(spark, sf_dir)), ParseOptions(long_edge=40))
    return parts.select(_id().alias("p_partkey"), F.col("ref").alias("size"), "mime")


@query("image_decoded", f"SELECT p_partkey, CAST(greatest(1, floor(w * s + 0.5)) AS INTEGER) AS width, CAST(greatest(1, floor(h * s + 0.5)) AS INTEGER) AS height FROM (SELECT *, least(1::DOUBLE, 40::DOUBLE / greatest(w, h)) AS s FROM {IMAGE_SQL})")
def image_decoded(spark, sf_dir):
    from docweave.sources.images import decoded

    return decoded(spark, *_pictures(spark, sf_dir), edge=40).select(_id().alias("p_partkey"), "width", "height")


@query("image_results", "SELECT p_partkey, concat('seal-1-', k) AS seal_id, 'image-bbox' AS locator_kind, 1 AS page_no FROM (SELECT *, unnest([1, 2]) AS k FROM part)")
def image_results(spark, sf_dir):
    found = _seen(spark, _pictures(spark, sf_dir), True)
    return found.select(_id().alias("p_partkey"), F.inline("raw.seals")).select("p_partkey", "seal_id", "locator_kind", "page_no")


# Images in documents: one more for each of three suppliers in turn.
def _letters(spark: SparkSession, sf_dir: str) -> list[str]:
    def make(name, n) -> bytes:
        from docweave.sources.writers import docx, png

        return docx([f"A letter of {name}"], [png(8 + k, 4) for k in range(n)])

    return _made_in(_spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") % 3 + 1).cast("int").alias("n"))), make, ["s_name", "n"], _named("s_suppkey", ".docx"))


@query("docx_images", "SELECT s_suppkey, CAST(k AS INTEGER) AS image_no, 1 AS n FROM (SELECT s_suppkey, unnest(range(1, CAST(s_suppkey % 3 + 2 AS INTEGER))) AS k FROM supplier)")
def docx_images(spark, sf_dir):
    return images_of(binary_files(spark, *_letters(spark, sf_dir))).groupBy(_id().alias("s_suppkey"), "image_no").agg(F.count_distinct("content").cast("int").alias("n"))


@query("docx_seals", "SELECT s_suppkey, concat('seal-docx-img', i, '-', (i - 1) * 2 + k) AS seal_id, concat('embedded-img-', i) AS section_id, 'image-bbox' AS locator_kind, CASE k WHEN 1 THEN 'ACME' END AS owner FROM (SELECT *, unnest([1, 2]) AS k FROM (SELECT s_suppkey, unnest(range(1, CAST(s_suppkey % 3 + 2 AS INTEGER))) AS i FROM supplier))")
def docx_seals(spark, sf_dir):
    found = _seen(spark, _letters(spark, sf_dir), True)
    return found.select(_id().alias("s_suppkey"), F.inline("raw.seals")).select("s_suppkey", "seal_id", "section_id", "locator_kind", "owner")


# Archives: one for each of twenty origins, with the web pages as entries.
ZIP_SQL = """(SELECT CAST(page_id % 20 AS BIGINT) AS origin, page_id, html, concat(CASE page_id % 7 WHEN 0 THEN '__MACOSX/' WHEN 1 THEN 'sub/' ELSE '' END, 'f', page_id, CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' WHEN 2 THEN '.zip' WHEN 3 THEN '.bin' ELSE '.txt' END) AS entry FROM pages)"""
KIND_SQL = "CASE page_id % 5 WHEN 0 THEN 'file' WHEN 2 THEN 'nested' WHEN 3 THEN 'skipped' ELSE 'text' END"


def _zips(spark: SparkSession, sf_dir: str, unsafe: bool = False) -> str:
    """The folder has a name with an exclamation mark, which parts archives from entries elsewhere in a path."""
    pick = lambda n, values, other: F.coalesce(F.get(F.array(*map(F.lit, values)), (F.col("page_id") % n).cast("int")), F.lit(other))
    name = F.concat(pick(7, ("__MACOSX/", "sub/"), ""), F.lit("f"), F.col("page_id").cast("string"), pick(5, (".pdf", ".md", ".zip", ".bin", ".txt"), ""))
    entries = table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("origin"), name.alias("name"), "html")

    class Archive:
        def __init__(self, stream):
            import zipfile

            self.origin, self.zip = 1, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)

        def add(self, r):
            self.put(r["name"], r["html"] or "")
            self.origin = r["origin"]

        def put(self, name: str, text: str):
            import zipfile

            self.zip.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)

        def close(self):
            if unsafe and self.origin % 4 == 0:
                self.put("../out.md", "x")
            self.zip.close()

    return _put_together(entries, "origin", ["name"], F.concat(F.lit("new!/"), _named("origin", ".zip")), Archive) + "/new!"


@query("zip_scan", f"SELECT origin, entry, CAST(row_number() OVER (PARTITION BY origin ORDER BY entry) AS INTEGER) AS sub, {KIND_SQL} AS kind, CAST(strlen(html) AS BIGINT) AS length, sha256(html) AS file_hash FROM {ZIP_SQL} WHERE NOT starts_with(entry, '__MACOSX/')")
def zip_scan(spark, sf_dir):
    zips = archives_at(spark, _zips(spark, sf_dir))
    # Small archives too are split here, but into no more partitions than a few for each core: they shall not grow in number with the input.
    share = sum(size for _, size in zips) // (4 * spark.sparkContext.defaultParallelism)
    found = classify_entries(read_archives(spark, zips, task_bytes=max(16_384, min(share, TASK_BYTES))))
    return found.select(_id("origin").alias("origin"), "entry", "sub", "kind", "length", "file_hash")


@query("zip_texts", f"SELECT origin, entry, html AS text FROM {ZIP_SQL} WHERE NOT starts_with(entry, '__MACOSX/') AND entry LIKE '%.txt'")
def zip_texts(spark, sf_dir):
    """The entries of one kind: the source reads no others."""
    found = read_archives(spark, archives_at(spark, _zips(spark, sf_dir)), entry="*.txt")
    return found.select(_id("origin").alias("origin"), "entry", F.col("content").cast("string").alias("text"))


@query("zip_entries_function", f"SELECT origin, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM {ZIP_SQL} WHERE NOT starts_with(entry, '__MACOSX/') GROUP BY origin")
def zip_entries_function(spark, sf_dir):
    from docweave.sources.scan import register

    register(spark)
    # By their paths: an archive may be larger than a cell, or than memory.
    listed(spark, _zips(spark, sf_dir)).repartition(2 * spark.sparkContext.defaultParallelism).createOrReplaceTempView("docweave_zips")
    found = spark.sql("SELECT path, e.entry, e.size FROM docweave_zips, LATERAL zip_entries_at(path) e")
    return found.groupBy(_id().alias("origin")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("zip_unsafe", f"SELECT origin, count(*) FILTER (origin % 4 <> 0 OR first) AS n_rows, origin % 4 = 0 AS failed FROM (SELECT origin, row_number() OVER (PARTITION BY origin ORDER BY entry) = 1 AS first FROM {ZIP_SQL} WHERE NOT starts_with(entry, '__MACOSX/')) GROUP BY origin")
def zip_unsafe(spark, sf_dir):
    """One unsafe name fails its archive, and no other."""
    found = read_archives(spark, archives_at(spark, _zips(spark, sf_dir, unsafe=True)))
    return found.groupBy(_id("origin").alias("origin")).agg(F.count("*").alias("n_rows"), F.bool_or(F.col("error_code").isNotNull()).alias("failed"))


@query("archive_slots", f"SELECT origin, CAST(row_number() OVER (PARTITION BY origin ORDER BY entry) AS INTEGER) AS sub, entry, CASE WHEN page_id % 5 = 0 THEN 'parse' ELSE 'passthrough' END AS kind FROM {ZIP_SQL} WHERE NOT starts_with(entry, '__MACOSX/') AND page_id % 5 NOT IN (2, 3)")
def archive_slots(spark, sf_dir):
    folder = _zips(spark, sf_dir)
    given = listed(spark, folder).select(_id().alias("origin"), "path")
    found = input_slots(given, read_archives(spark, archives_at(spark, folder)).select("path", "entry", "error_code", "error_message"))
    return found.select("origin", "sub", files.inner_name(F.col("path")).alias("entry"), "kind")


@query("archive_summary", f"SELECT origin, count(*) FILTER (page_id % 5 = 0) AS expanded, count(*) FILTER (page_id % 5 IN (1, 4)) AS passthrough, count(*) FILTER (page_id % 5 = 2) AS warnings FROM {ZIP_SQL} WHERE NOT starts_with(entry, '__MACOSX/') GROUP BY origin")
def archive_summary(spark, sf_dir):
    entries = read_archives(spark, archives_at(spark, _zips(spark, sf_dir))).select("path", "entry", "error_code", "error_message")
    return archive_summaries(entries).select(_id("archive").alias("origin"), "expanded", "passthrough", F.size("warnings").cast("long").alias("warnings"))


# All at once: documents as texts, documents, PDFs, workbooks and files of an unknown kind in turn, to Markdown.
MIXED = (".md", ".docx", ".pdf", ".xlsx", ".bin")


def _mixed(spark: SparkSession, sf_dir: str) -> list[str]:
    def make(doc_id, text) -> bytes:
        from docweave.sources.writers import docx, pdf, xlsx

        kind = MIXED[doc_id % 5]
        if kind == ".docx":
            return docx(text.split("\n"))
        if kind == ".pdf":
            return pdf([text[:400], text[400:800]])
        return xlsx({"Lines": [["no", "chars"], *([k, len(line)] for k, line in enumerate(text.split("\n"), 1))]}) if kind == ".xlsx" else text.encode()

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ending = F.get(F.array(*map(F.lit, MIXED)), (F.col("doc_id") % 5).cast("int"))
    return _made_in(_spread(docs), make, ["doc_id", "text"], F.concat(F.lit("f"), F.col("doc_id").cast("string"), ending))


PAGE_MD = "concat('## Page {n}', E'\\n\\n', CASE WHEN length(trim(substr(text, {a}, 400), E' \\n\\t\\r')) < 20 THEN '[mock-ocr] recognized text' ELSE trim(substr(text, {a}, 400), E' \\n\\t\\r') END)"
MIXED_SQL = f"""SELECT d.doc_id, d.doc_id % 5 <> 4 AS ok, CASE d.doc_id % 5 WHEN 0 THEN text
  WHEN 1 THEN concat('# f', d.doc_id, E'.docx\\n\\n', coalesce(s.md, ''), chr(10))
  WHEN 2 THEN concat('# f', d.doc_id, E'.pdf\\n\\n', {PAGE_MD.format(n=1, a=1)}, E'\\n\\n', {PAGE_MD.format(n=2, a=401)}, chr(10))
  WHEN 3 THEN concat('# f', d.doc_id, E'.xlsx\\n\\n## Lines\\n\\n| A | B |\\n| --- | --- |\\n| no | chars |\\n', (SELECT string_agg(concat('| ', i, ' | ', length(x), ' |'), chr(10) ORDER BY i) FROM (SELECT unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x)), chr(10)) END AS md,
  CASE WHEN d.doc_id % 5 = 4 THEN 'ERR_UNSUPPORTED_FORMAT' END AS code
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) d LEFT JOIN (SELECT doc_id, string_agg(trim(text, E' \\n\\t\\r'), E'\\n\\n' ORDER BY k) AS md FROM {SECTIONS_SQL} GROUP BY doc_id) s ON d.doc_id = s.doc_id"""


@query("extract_files", MIXED_SQL)
def extract_files(spark, sf_dir):
    found = DocEngine(spark, resolve({})).extract(_mixed(spark, sf_dir), detect=False)
    return found.select(_id().alias("doc_id"), "ok", F.col("markdown").alias("md"), F.col("error_code").alias("code"))


@query("result_sources", "SELECT doc_id, concat('f', doc_id, list_extract(['.md', '.docx', '.pdf', '.xlsx'], CAST(doc_id % 5 + 1 AS INTEGER))) AS file_name, list_extract([NULL, 'docx', 'pdf', 'xlsx'], CAST(doc_id % 5 + 1 AS INTEGER)) AS file_format, CASE doc_id % 5 WHEN 3 THEN 'Lines' END AS sheet, CASE doc_id % 5 WHEN 2 THEN 2 END AS last_page, '1.0' AS schema_version, CAST(0 AS BIGINT) AS field_count FROM documents WHERE doc_id % 5 <> 4")
def result_sources(spark, sf_dir):
    found = DocEngine(spark, resolve({})).results(_mixed(spark, sf_dir), detect=False).where("ok")
    s = F.col("source")
    return found.select(_id().alias("doc_id"), s["file_name"].alias("file_name"), s["file_format"].alias("file_format"), F.get(s["sheet_names"], F.lit(0)).alias("sheet"), F.array_max(s["pages_included"]).alias("last_page"), "schema_version", F.col("metrics.quality.field_count").alias("field_count"))


@query("written_markdown", MIXED_SQL.replace("SELECT d.doc_id, d.doc_id % 5 <> 4 AS ok,", "SELECT doc_id, concat('f', doc_id, '.md') AS out_name, md FROM (SELECT d.doc_id, d.doc_id % 5 <> 4 AS ok,") + ") WHERE ok")
def written_markdown(spark, sf_dir):
    """The Markdown files, read back."""
    from docweave.plans.sinks import write_markdown

    found, out = DocEngine(spark, resolve({})).extract(_mixed(spark, sf_dir), detect=False), shared_folder(spark)
    rows = found.where("ok").select(F.lit(0).alias("origin"), _id(kind="int").alias("sub"), "path", "markdown")
    write_markdown(rows, out).write.format("noop").mode("overwrite").save()
    back = binary_files(spark, out, pattern="*.md")
    return back.select(_id().alias("doc_id"), files.base_name(F.col("path")).alias("out_name"), F.col("content").cast("string").alias("md"))
