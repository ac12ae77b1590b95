"""Files as DataFrames: scan, explode archives, parse by format; errors are rows, never exceptions in a task."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import files
from docweave.sources.store import exists, hadoop_path, stored
from docweave.sources.xlsx_source import XlsxSource
from docweave.sources.zip_source import archives_at, read_archives

ERROR = "error_code string, error_message string"
#: What a parsed part is: a page, an image, an image in a document, a cell, a sheet, merged cells, a document's text or a text; number is its place (page, or running number in the file).
PARTS = f"path string, kind string, number int, sheet string, ref string, text string, value_type string, formula string, total int, image binary, mime string, ms long, {ERROR}"
NAMES = [p.split()[0] for p in PARTS.split(", ")]
PROTECTED = "ERR_PROTECTED_FILE"


@dataclass(frozen=True)
class ParseOptions:
    """What files are parsed by. renderer(pdf, page from 0, long edge) draws a page as bytes and kind, or None."""

    full_pages: bool = False
    max_pages: int = files.MAX_PAGES
    page_ratio: tuple[int, int] = files.PAGE_RATIO
    detect: bool = False
    long_edge: int = 2000
    renderer: Callable | None = None


#: Parts that are held before they are given on.
BATCH = 10_000
#: Bytes of contents, texts and images that are held before they are given on.
BATCH_BYTES = 8 << 20
#: Bytes and files that a task reads, about.
TASK_BYTES, TASK_FILES = 64 << 20, 20_000


def _alternatives(pattern: str) -> list[str]:
    """A pattern of names with {a,b} as patterns without."""
    found = re.match(r"(?s)(.*?)\{([^{}]*)\}(.*)\Z", pattern)
    return [x for one in found[2].split(",") for x in _alternatives(found[1] + one + found[3])] if found else [pattern]


def _rooted(spark: SparkSession, path: str) -> list[str]:
    """A path with its store, or those that a pattern stands for."""
    there, system = hadoop_path(spark, path)
    if system.exists(there):
        return [system.makeQualified(there).toString()]
    statuses = system.globStatus(there) if re.search(r"[*?\[{]", path) else None
    if not statuses:
        raise FileNotFoundError(f"path does not exist: {path}")
    return [s.getPath().toString() for s in statuses]


def listed(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """path, length of the files at the paths (files, folders or patterns), as Spark has it: not those in folders below, nor hidden ones (but empty ones too). Tasks list the folders, a row goes on as it is found: the driver never holds the names, of which there may be millions."""
    roots = [(r,) for p in paths for r in _rooted(spark, p)]
    patterns = _alternatives(pattern) if pattern else None

    def run(batches) -> Iterator:
        import os
        from fnmatch import fnmatchcase

        import pyarrow as pa

        from docweave.sources.sink import file_system

        def files_at(root: str) -> Iterator[tuple[str, int]]:
            from pyarrow import fs

            system, inner = file_system(root)
            if isinstance(system, fs.LocalFileSystem):
                if os.path.isdir(inner):
                    with os.scandir(inner) as entries:
                        for e in entries:
                            if not hidden(e.name) and e.is_file():
                                yield f"{root.rstrip('/')}/{e.name}", e.stat().st_size
                else:
                    yield root, os.path.getsize(inner)
                return
            own = system.get_file_info(inner)
            if own.type == fs.FileType.File:
                yield root, own.size
            else:
                yield from ((f"{root.rstrip('/')}/{i.base_name}", i.size) for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and not hidden(i.base_name))

        def hidden(name: str) -> bool:
            return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")

        def asked(path: str) -> bool:
            return patterns is None or any(fnmatchcase(path.rsplit("/", 1)[-1], p) for p in patterns)

        for batch in batches:
            for root in batch.column("root").to_pylist():
                found = ((p, n) for p, n in files_at(root) if asked(p))
                while rows := list(islice(found, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["path", "length"])

    tasks = max(1, min(len(roots), 2 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(roots, "root string").repartition(tasks).mapInArrow(run, "path string, length long")


def dealt(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """path, length of the files that listed() gives. They are listed once, into the shared folder, and dealt over tasks of about TASK_BYTES each."""
    names = stored(listed(spark, *paths, pattern=pattern))
    return names.repartition(tasks_of(names))


def tasks_of(found: DataFrame) -> int:
    """How many tasks files (length) are dealt over."""
    count, total = found.agg(F.count("*"), F.sum("length")).first()
    return int(max(min(count, 2 * found.sparkSession.sparkContext.defaultParallelism), -(-(total or 0) // TASK_BYTES), -(-count // TASK_FILES), 1))


def opener() -> Callable[[str], bytes]:
    """A function that gives the content of the file at a path."""
    from docweave.sources.sink import file_system

    systems = {}

    def read(path: str) -> bytes:
        store = path.partition("://")[0] if "://" in path else ""
        if store not in systems:
            systems[store] = file_system(path)[0]
        inner = path.removeprefix("file:") if not store else file_system(path)[1]
        with systems[store].open_input_file(inner) as f:
            return f.read()

    return read


def binary_files(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """path, length, content, file_hash of the files that listed() gives, as dealt() deals them; a task opens its own."""

    def run(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        def given(rows):
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "length", "content", "file_hash"])

        rows, held, read = [], 0, opener()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                content = read(path)
                rows.append((path, len(content), content, hashlib.sha256(content).hexdigest()))
                held += len(content)
                if held >= BATCH_BYTES or len(rows) >= BATCH:
                    yield given(rows)
                    rows, held = [], 0
        if rows:
            yield given(rows)

    return dealt(spark, *paths, pattern=pattern).mapInArrow(run, "path string, length long, content binary, file_hash string")


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that do not exist, in their store."""
    return [p for p in paths if not exists(spark, p)]


def expand_archives(found: DataFrame) -> DataFrame:
    """Files with the entries of ZIP archives in their place: path (archive!entry), origin (the path of the file), entry, sub (the entry's place by name), content, file_hash, length, error. A bad archive is one row with an error, a bad entry another."""

    def run(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        from docweave.sources import archives

        names = ["path", "origin", "entry", "sub", "content", "file_hash", "length", "error_code", "error_message"]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not path.lower().endswith(files.ARCHIVE_EXTENSION):
                    opened = iter([(None, content, None)])
                else:
                    try:
                        opened = archives.entries(content)
                        first = next(opened, None)
                        opened = chain([first], opened) if first else iter(())
                    except Exception as e:
                        opened = iter([(None, None, str(e))])
                for k, (name, data, error) in enumerate(opened, 1):  # one entry is unpacked at a time
                    row = (f"{path}!{name}" if name else path, path, name, k if name else 0, data, hashlib.sha256(data).hexdigest() if data is not None else None, len(data) if data is not None else None, files.UNSUPPORTED if error else None, error)
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names)

    return found.select("path", "content").mapInArrow(run, f"path string, origin string, entry string, sub int, content binary, file_hash string, length long, {ERROR}")


#: Names that do not end in .zip, in any case, as a glob.
NO_ARCHIVE = "{*[!pP],[pP],*[!iI][pP],[iI][pP],*[!zZ][iI][pP],[zZ][iI][pP],*[!.][zZ][iI][pP]}"


def scan_files(spark: SparkSession, *paths: str, contents: bool = True) -> DataFrame:
    """Files at the paths with the entries of archives in their place, as expand_archives() gives them; archives are read by their entries. Without contents, files that are none have no content nor file_hash: parse_files() opens them."""
    zips = archives_at(spark, *paths)
    none = F.lit(None).cast("string")
    own = (binary_files if contents else dealt)(spark, *paths, pattern=NO_ARCHIVE)  # by name, before anything is read: an archive may be larger than a cell
    if not contents:
        own = own.withColumns({"content": F.lit(None).cast("binary"), "file_hash": none})
    own = own.select("path", F.col("path").alias("origin"), none.alias("entry"), F.lit(0).alias("sub"), "content", "file_hash", "length", none.alias("error_code"), none.alias("error_message"))
    return own.unionByName(read_archives(spark, zips)) if zips else own


def hashed(found: DataFrame) -> DataFrame:
    """A scan with file_hash and length of the files that it only names, too. They are read for that, one at a time, and their contents are not kept."""

    def run(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        read = opener()
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            hashes, lengths, errors = (columns[n].to_pylist() for n in ("file_hash", "length", "error_message"))
            for k in range(batch.num_rows):
                if hashes[k] is None and errors[k] is None:
                    content = read(columns["path"][k].as_py())
                    hashes[k], lengths[k] = hashlib.sha256(content).hexdigest(), len(content)
            columns |= {"file_hash": pa.array(hashes, pa.string()), "length": pa.array(lengths, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return found.mapInArrow(run, found.schema)


def _row(path: str, kind: str, number: int = 0, **given) -> tuple:
    return tuple({"path": path, "kind": kind, "number": number, **given}.get(n) for n in NAMES)


def _fit(image: bytes | None, options: ParseOptions) -> str | None:
    """A mark for an image that only Spark's image source can make fit."""
    from docweave.sources import images

    return images.UNFITTED if image and images.unfitted(image, options.long_edge) else None


def parse_one(path: str, content: bytes, options: ParseOptions = ParseOptions()) -> Iterator[tuple]:
    """The parts of a file (see PARTS)."""
    from docweave.functions.text import OCR_TEXT_THRESHOLD
    from docweave.sources import doc, docx, images, pdf, xls, xlsx

    inner = re.match(files.ENTRY, path)
    name = (inner[2] if inner else path).rsplit("/", 1)[-1]
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""
    try:
        if ext in files.TEXT_EXTENSIONS:
            yield _row(path, "text", 1, text=content.decode("utf-8", "replace"), total=1)
        elif ext == ".pdf":
            read, draw = pdf.Pdf(content), options.renderer or pdf.page_image
            total = len(read.pages)
            for no in range(1, total + 1) if options.full_pages else pdf.select_pages(total, options.max_pages, options.page_ratio):
                text = read.text(no - 1)
                drawn = draw(read, no - 1, options.long_edge) if options.detect or len(text) < OCR_TEXT_THRESHOLD else None
                yield _row(path, "page", no, text=text, total=total, image=drawn and drawn[0], mime=drawn and drawn[1], value_type=_fit(drawn and drawn[0], options))
        elif ext in (".xlsx", ".xls"):
            read = xlsx if ext == ".xlsx" else xls
            for k, name in enumerate(read.sheet_names(content), 1):
                yield _row(path, "sheet", k, sheet=name)
            for name, ref in read.merged_ranges(content):
                yield _row(path, "merge", sheet=name, ref=ref)
            for k, c in enumerate(read.cells(content), 1):
                yield _row(path, "cell", k, sheet=c.sheet, ref=c.ref, text=c.text, value_type=c.kind, formula=c.formula)
        elif ext == ".docx":
            yield _row(path, "document", 1, text=docx.raw_text(content))
            for no, image in docx.images(content) if options.detect else ():
                yield _row(path, "embedded", no, image=image, mime=images.kind_of(image), value_type=_fit(image, options))
        elif ext == ".doc":
            try:
                yield _row(path, "document", 1, text=doc.raw_text(content))
            except Exception as e:
                yield _row(path, "error", error_code=files.UNSUPPORTED, error_message=f"Failed to parse legacy .doc file: {e}")
        elif ext in (".jpg", ".jpeg", ".png"):
            width, height = images.fitted(*images.size(content), edge=options.long_edge)
            sent, mime = images.prepared(content, options.long_edge)
            yield _row(path, "image", 1, ref=f"{width}x{height}", total=1, image=sent, mime=mime, value_type=_fit(sent, options))
        else:
            yield _row(path, "error", error_code=files.UNSUPPORTED, error_message=f"Unsupported file extension: {ext or '(none)'}")
    except pdf.Protected as e:
        yield _row(path, "error", error_code=PROTECTED, error_message=str(e))
    except Exception as e:  # a broken file has no code of its own
        yield _row(path, "error", error_message=f"{type(e).__name__}: {e}")


def parse_files(found: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """found (path, content; or path alone, of files that are opened here, one at a time) as PARTS (an image's value_type says if it does not fit yet, see images.upright); ms is a file's time, on its last part. A file's parts are given on as they are found. One that fails has an error as its only part, or, after so many parts that some are given on already, as its last.

    Where found is a scan with file_hash, length and errors, each file has a part of kind file besides, with
    its hash as text and its length as ref, and what could not be opened is a part of kind error: so that
    contents are read once. What it has only named is opened here.

    Where found says at which path a file is (at, file_hash), its own path is only its name, and a file without
    content is opened there; one that has changed since it was hashed is an error.
    """
    scanned = "file_hash" in found.columns and "error_message" in found.columns
    elsewhere = "at" in found.columns
    columns = [c for c in ("path", "content") if c in found.columns] + (["file_hash", "length", "error_code", "error_message"] if scanned else ["at", "file_hash"] if elsewhere else [])

    def parts(row: tuple) -> Iterator[tuple]:
        path, content, *more = row
        if more and more[-1] is not None:
            yield _row(path, "error", error_code=more[-2], error_message=more[-1])
            return
        if scanned:
            yield _row(path, "file", text=more[0], ref=str(more[1]))
        began, held, given = time.monotonic(), [], False
        for r in parse_one(path, content or b"", options):
            if r[1] == "error" and not given:
                held.clear()
            held.append(r)
            if len(held) > BATCH:  # one is held back, for the time
                yield from held[:-1]
                held, given = held[-1:], True
        if held:
            held[-1] = (*held[-1][:11], int((time.monotonic() - began) * 1000), *held[-1][12:])
        yield from held

    def run(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string())
        def given(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

        read = opener()

        def whole(path: str, content: bytes | None = None, *more) -> tuple:
            if "content" not in columns:
                return path, read(path)
            if elsewhere:
                at, known = more
                if content is None and hashlib.sha256(content := read(at)).hexdigest() != known:
                    return path, None, None, f"the file changed while it was read: {at}"
                return path, content
            if scanned and content is None and more[0] is None and more[3] is None:
                content = read(path)
                more = (hashlib.sha256(content).hexdigest(), len(content), None, None)
            return path, content, *more

        # The parts of many small files are one batch, those of a large one many.
        rows, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):  # one content is in memory beside its batch
                for r in parts(whole(*(c[k].as_py() for c in batch.columns))):
                    rows.append(r)
                    held += len(r[5] or "") + len(r[9] or b"")
                    if len(rows) >= BATCH or held >= BATCH_BYTES:
                        yield given(rows)
                        rows, held = [], 0
        if rows:
            yield given(rows)

    return found.select(*columns).mapInArrow(run, PARTS)


def images_of(found: DataFrame) -> DataFrame:
    """The images in DOCX files: path, image_no, content."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        from docweave.sources import docx

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = list(docx.images(content))
                except Exception:
                    rows = []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], ["path", "image_no", "content"])

    return found.where(F.lower("path").endswith(".docx")).select("path", "content").mapInArrow(run, "path string, image_no int, content binary")


class ZipEntries:
    """UDTF: entry and size of an archive's entries; -1 for one that cannot be read."""

    def eval(self, content: bytes):
        from docweave.sources import archives

        for name, data, error in archives.entries(bytes(content)):
            yield name, -1 if error else len(data)


class ZipEntriesAt:
    """UDTF: as zip_entries, of an archive at a path, which is read in place: an entry is in memory at a time."""

    def eval(self, path: str):
        from docweave.sources import archives
        from docweave.sources.zip_source import opened

        with opened(path) as z:
            for info in archives.listing(z):
                data, error = archives.content_of(z, info)
                yield info.filename, -1 if error else len(data)


class XlsxCells:
    """UDTF: sheet, ref, value_type, text of a workbook's cells."""

    def eval(self, content: bytes):
        from docweave.sources import xlsx

        for c in xlsx.cells(bytes(content)):
            yield c.sheet, c.ref, c.kind, c.text


class PdfPages:
    """UDTF: page_no, total, text. The pages are chosen before they are decoded."""

    def eval(self, content: bytes, full: bool):
        from docweave.sources import pdf

        yield from pdf.pages(bytes(content), None if full else pdf.select_pages)


def register(spark: SparkSession) -> None:
    """The functions for SQL: LATERAL zip_entries(content), zip_entries_at(path), xlsx_cells(content), pdf_pages(content, full)."""
    spark.udtf.register("zip_entries", F.udtf(ZipEntries, returnType="entry: string, size: long"))
    spark.udtf.register("zip_entries_at", F.udtf(ZipEntriesAt, returnType="entry: string, size: long"))
    spark.udtf.register("xlsx_cells", F.udtf(XlsxCells, returnType="sheet: string, ref: string, value_type: string, text: string"))
    spark.udtf.register("pdf_pages", F.udtf(PdfPages, returnType="page_no: int, total: int, text: string"))
    spark.dataSource.register(XlsxSource)
