"""The sink's commit: all files or none, and nothing left beside them."""

import os

import pytest

from pyspark.sql import functions as F

from docweave.sources.sink import FileSink, FileWriter, commit_files
from docweave.sources.store import shared_root


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


def rows(spark, folder, n=40):
    return spark.range(n).select(F.concat(F.lit(f"{folder}/d"), F.col("id") % 3, F.lit("/f"), F.col("id"), F.lit(".md")).alias("path"), F.concat(F.lit("text "), F.col("id")).alias("content"))


def journals(spark):
    return [f for f in tree(shared_root(spark)) if "/lists/" in f or "/folders/" in f]


def test_commit(spark, tmp_path):
    (tmp_path / "d0").mkdir()
    (tmp_path / "d0" / "f0.md").write_text("earlier and longer than what comes")
    commit_files(rows(spark, tmp_path).repartition(7))
    assert tree(tmp_path) == sorted(f"d{k % 3}/f{k}.md" for k in range(40))
    assert (tmp_path / "d0" / "f0.md").read_text() == "text 0" and (tmp_path / "d1" / "f37.md").read_text() == "text 37"
    assert not [d for d, _, _ in os.walk(tmp_path) if "docweave-" in d] and not journals(spark)


def test_failed_tasks_leave_nothing(spark, tmp_path):
    (tmp_path / "d0").mkdir()
    (tmp_path / "d0" / "f0.md").write_text("earlier")

    def broken(batches):
        for batch in batches:
            if "f39.md" in str(batch.column("path")):
                raise ValueError("broken source")
            yield batch

    with pytest.raises(Exception, match="broken source"):
        commit_files(rows(spark, tmp_path).repartition(5).select("path", F.col("content").cast("binary").alias("content")).mapInArrow(broken, "path string, content binary"))
    assert tree(tmp_path) == ["d0/f0.md"] and (tmp_path / "d0" / "f0.md").read_text() == "earlier"
    assert not [d for d, _, _ in os.walk(tmp_path) if "docweave-" in d] and not journals(spark)


def test_attempts_that_are_lost_or_doubled(tmp_path):
    """One task is lost half-way without a word, another runs twice: only what was committed shows."""
    import pyarrow as pa

    writer = FileWriter(str(tmp_path / "journal"))
    batch = lambda *names: pa.RecordBatch.from_arrays([pa.array([f"{tmp_path}/out/{n}" for n in names]), pa.array([n.encode() for n in names])], ["path", "content"])

    def dies():
        yield batch("a.md")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(dies())
    assert not os.path.exists(tmp_path / "out" / "a.md")
    messages = [writer.write(iter([batch("a.md", "b.md")])), writer.write(iter([batch("c.md"), batch("d.md")]))]
    writer.write(iter([batch("c.md", "d.md")]))  # a twin that is not committed
    writer.commit(messages)
    assert tree(tmp_path) == ["out/a.md", "out/b.md", "out/c.md", "out/d.md"] and (tmp_path / "out" / "d.md").read_text() == "d.md"
    writer.commit([])  # nothing is left to do
    assert FileSink.name() == "markdown_files"


def test_empty(spark, tmp_path):
    commit_files(rows(spark, tmp_path).where("false"))
    assert tree(tmp_path) == []
