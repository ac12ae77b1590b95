"""Paths with exclamation marks, in folders, archives and entries."""

import pytest
from fixtures import zipped

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import files
from docweave.operators.archives import archive_summaries, input_slots
from docweave.plans.engine import DocEngine
from docweave.plans.sinks import output_names
from docweave.sources.scan import binary_files, expand_archives

CASES = [
    ("/d/a.zip!b.md", "b.md", "/d/a/b.md"),
    ("/wow!/a.zip!in/b!c.md", "in/b!c.md", "/wow!/a/in/b!c.md"),
    ("/wow!/report.pdf", "/wow!/report.pdf", "/wow!/report.md"),
    ("/d/x!y.pdf", "/d/x!y.pdf", "/d/x!y.md"),
    ("/d/x.zip!/y.pdf", "/d/x.zip!/y.pdf", "/d/x.zip!/y.md"),
    ("/d/A!.ZIP!z.zip!q.md", "z.zip!q.md", "/d/A!/z.zip!q.md"),
]


@pytest.mark.parametrize("path, name, out", CASES)
def test_names(spark, path, name, out):
    row = output_names(spark.createDataFrame([(1, 0, path)], "origin int, sub int, path string")).select(files.inner_name(F.col("path")).alias("name"), "out_file").first()
    assert (row["name"], row["out_file"]) == (name, out)


def test_archives_under_any_folder(spark, tmp_path):
    for folder in ("wow", "wow!", "a!b!"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a!1.zip").write_bytes(zipped({"x!.md": "one", "in/y.md": "two", "n.zip": zipped({})}))
        (tmp_path / folder / "c!.md").write_text("three")
    found = binary_files(spark, *(str(tmp_path / f) for f in ("wow", "wow!", "a!b!")))
    paths = found.select(F.row_number().over(Window.orderBy("path")).alias("origin"), "path")
    entries = expand_archives(found.where(F.col("path").endswith(".zip"))).select("path", "entry", "error_code", "error_message")
    slots = input_slots(paths, entries).collect()
    shown = sorted((r["path"].split("/")[-2 if "!in/" not in r["path"] else -3], files_name(r["path"]), r["sub"]) for r in slots)
    assert shown == sorted((f, n, s) for f in ("wow", "wow!", "a!b!") for n, s in (("c!.md", 0), ("in/y.md", 1), ("x!.md", 2)))
    assert {(r["archive"].split("/")[-2], r["expanded"], r["passthrough"], len(r["warnings"])) for r in archive_summaries(entries).collect()} == {(f, 0, 2, 1) for f in ("wow", "wow!", "a!b!")}
    results = DocEngine(spark).results([str(tmp_path / "wow!")]).where("ok").collect()
    assert sorted((r["source"]["file_name"], r["markdown"]) for r in results) == [("c!.md", "three"), ("x!.md", "one"), ("y.md", "two")]


def files_name(path):
    return path.split(".zip!")[1] if ".zip!" in path else path.rsplit("/", 1)[-1]
