"""Archives planned by entries: the same rows as by content, split, filtered before they are read."""

import fnmatch
import zipfile

import pytest
from fixtures import zipped

from pyspark.sql import functions as F

from docweave.sources.scan import binary_files, expand_archives, scan_files
from docweave.sources.zip_source import NAMES, archives_at, read_archives


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("zips!")
    (d / "many.zip").write_bytes(zipped({f"in/e{k:03}.txt": f"text {k} " * 500 for k in range(60)} | {"__MACOSX/x": "junk", "in/": ""}))
    for k in range(5):
        (d / f"small{k}.ZIP").write_bytes(zipped({"a!.md": f"# {k}", "z.pdf": b"%PDF"}))
    (d / "unsafe.zip").write_bytes(zipped({"../x.md": "y", "ok.md": "z"}))
    (d / "broken.zip").write_bytes(b"not an archive")
    good = zipped({"one.txt": "first entry", "two.txt": "second entry"})
    (d / "damaged.zip").write_bytes(good.replace(b"second entry", b"SECOND entry"))
    (d / "none.zip").write_bytes(zipped({}))
    (d / "other.txt").write_text("no archive")
    return d


def rows(df):
    return sorted(map(tuple, df.select(*NAMES[:7], "error_code").collect()), key=str)


@pytest.mark.parametrize("task_bytes", [1, 300, 1 << 20])
def test_same_rows(spark, folder, task_bytes):
    found = read_archives(spark, archives_at(spark, str(folder)), task_bytes=task_bytes)
    assert rows(found) == rows(expand_archives(binary_files(spark, str(folder), pattern="*.{zip,ZIP}")))
    assert (found.rdd.getNumPartitions() > 8) == (task_bytes < 1000)


def test_an_archive_in_several_tasks(spark, folder):
    found = read_archives(spark, archives_at(spark, str(folder / "many.zip")), task_bytes=2000)
    by_task = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(by_task) == 60 and len(by_task) >= 3 and max(by_task) <= 30


def test_entries_by_name(spark, folder):
    names = lambda df: sorted((r["origin"], r["entry"] or "") for r in df.collect())
    every = expand_archives(binary_files(spark, str(folder), pattern="*.{zip,ZIP}")).collect()
    for entry in ("in/e007.txt", "in/e00*", "*.md", "*!*", "none"):
        want = sorted((r["origin"], r["entry"] or "") for r in every if r["entry"] is None or fnmatch.fnmatchcase(r["entry"], entry))
        for task_bytes in (300, 1 << 20):
            assert names(read_archives(spark, archives_at(spark, str(folder)), task_bytes=task_bytes, entry=entry)) == want
    few, all_ = (read_archives(spark, archives_at(spark, str(folder / "many.zip")), task_bytes=300, entry=e) for e in ("in/e007.txt", None))
    assert few.rdd.getNumPartitions() == 1 < all_.rdd.getNumPartitions()


def test_a_frame_is_whole_after_a_filter(spark, folder):
    found = read_archives(spark, archives_at(spark, str(folder / "many.zip")))
    assert (found.where("entry = 'in/e003.txt'").count(), found.count(), found.where("entry like 'in/e01%'").count()) == (1, 60, 10)


def test_larger_than_a_cell(spark, tmp_path):
    """Only the directory and the asked entry are read of an archive of any size."""
    with zipfile.ZipFile(tmp_path / "large.zip", "w") as z:
        for k in range(40):
            z.writestr(f"e{k}.bin", bytes(1 << 20))
    found = read_archives(spark, archives_at(spark, str(tmp_path)), task_bytes=4 << 20)
    assert found.rdd.getNumPartitions() == 10 and found.where(F.col("entry") == "e7.bin").select("length").first()[0] == 1 << 20


def test_only_archives_are_left_out_by_name(spark, tmp_path):
    names = ["a.zip", "b.ZIP", "c.Zip", "zip", "ip", "p", "x.zi", "azip", "x.zap", "x.tip", "x.pdf", "y.zip.md", "zipp", "z.gzip"]
    for n in names:
        (tmp_path / n).write_bytes(zipped({"e.md": "x"}) if n.lower().endswith(".zip") else b"x")
    found = {r["path"].rsplit("/", 1)[1] for r in scan_files(spark, str(tmp_path)).collect()}
    assert found == {f"{n}!e.md" if n.lower().endswith(".zip") else n for n in names}
    assert scan_files(spark, str(tmp_path / "a.zip")).count() == 1 == scan_files(spark, str(tmp_path / "zip")).count()


def test_zip_scan_partitions_do_not_grow_with_the_input(spark, monkeypatch):
    """Archives of 600 MB are some partitions for each core, not one for each 16 KB."""
    from docweave.plans import scan_queries

    asked = []

    class Asked(Exception):
        pass

    def read(spark, found, task_bytes):
        asked.append(task_bytes)
        raise Asked

    monkeypatch.setattr(scan_queries, "_zips", lambda spark, sf_dir: "")
    monkeypatch.setattr(scan_queries, "read_archives", read)
    for size in (1000, 600 << 20):
        monkeypatch.setattr(scan_queries, "archives_at", lambda spark, path, size=size: [("file:/none/f1.zip", size)])
        with pytest.raises(Asked):
            scan_queries.zip_scan(spark, "")
    assert asked[0] == 16_384 and (600 << 20) / asked[1] <= 5 * spark.sparkContext.defaultParallelism


def test_archives_and_workbooks_larger_than_memory(tmp_path):
    """Entries and rows go to the stream as they come, and a path is read in place: of 64 MB of entries (and of 60,000 rows) a few are held."""
    import tracemalloc
    import zipfile

    from pyarrow import fs

    from docweave.sources import xlsx
    from docweave.sources.scan import ZipEntriesAt
    from docweave.sources.writers import XlsxWriter

    system, at = fs.LocalFileSystem(), str(tmp_path)
    tracemalloc.start()
    with system.open_output_stream(f"{at}/a.zip") as stream, zipfile.ZipFile(stream, "w") as z:
        for k in range(64):
            z.writestr(zipfile.ZipInfo(f"e{k:02}.txt"), bytes([k]) * (1 << 20))
    assert list(ZipEntriesAt().eval(f"file:{at}/a.zip")) == [(f"e{k:02}.txt", 1 << 20) for k in range(64)]
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.reset_peak()
    with system.open_output_stream(f"{at}/a.xlsx") as stream:
        book = XlsxWriter(stream)
        for k in range(60_000):
            book.row("A & B" if k < 40_000 else "C", [k, f"text <{k}>", None, k % 2 == 0, ""], ["A1:B1"])
        book.close()
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
    content = open(f"{at}/a.xlsx", "rb").read()
    assert xlsx.sheet_names(content) == ["A & B", "C"] and list(xlsx.merged_ranges(content)) == [("A & B", "A1:B1"), ("C", "A1:B1")]
    found = list(xlsx.cells(content))
    assert len(found) == 180_000 and [(c.sheet, c.ref, c.kind, c.text) for c in found[-3:]] == [("C", "A20000", "number", "59999"), ("C", "B20000", "string", "text <59999>"), ("C", "D20000", "boolean", "false")]
