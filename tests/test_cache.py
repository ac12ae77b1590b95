"""The result cache: pruned lookups, the latest row, compaction."""

import glob
import os

from pyspark.sql import functions as F

from docweave.operators import cache

KEYS = "sha2(cast(id as string), 256) AS cache_key"


def rows(spark, low, high):
    return spark.range(low, high).selectExpr("id", KEYS)


def through(df, path, word, **options):
    seen = []

    def compute(todo):
        seen.append(todo.count())
        return todo.select("cache_key", F.concat(F.lit(f"{word} "), "id").alias("value"), (F.col("id") % 10 != 9).alias("ok"))

    found = cache.through_cache(df, path, compute, good=F.col("ok"), **options)
    return {r["id"]: (r["value"], r["cache_hit"]) for r in df.join(found, "cache_key").collect()}, seen[0]


def test_through(spark, tmp_path):
    path = str(tmp_path / "c")
    got, asked = through(rows(spark, 0, 50), path, "one")
    assert asked == 50 and got == {k: (f"one {k}", False) for k in range(50)}
    got, asked = through(rows(spark, 20, 80), path, "two")
    hit = lambda k: k < 50 and k % 10 != 9
    assert asked == sum(not hit(k) for k in range(20, 80)) and got == {k: (f"one {k}", True) if hit(k) else (f"two {k}", False) for k in range(20, 80)}
    got, asked = through(rows(spark, 0, 10), path, "three", force=True)
    assert asked == 10 and got[3] == ("three 3", False)
    assert through(rows(spark, 0, 5), path, "four")[0] == {k: (f"three {k}", True) for k in range(5)}


def test_lookup_reads_the_asked_folders(spark, tmp_path):
    path = str(tmp_path / "c")
    through(rows(spark, 0, 400), path, "one")
    asked = rows(spark, 7, 9).select("cache_key")
    found = cache.lookup(spark, path, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    folders = {r[0] for r in asked.select(cache.folder_of(F.col("cache_key"))).collect()}
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "PushedFilters: [In(cache_key" in scan and all(f in scan.split("PartitionFilters")[1] for f in folders)
    assert found.count() == 2 and len(os.listdir(path)) > 10
    read = {r[0].split("key_prefix=")[1].split("/")[0] for r in found.select(F.input_file_name()).collect()}
    assert read == folders
    many = rows(spark, 0, 400).select("cache_key")  # more keys than a filter names
    assert cache.lookup(spark, path, many).count() == 400
    odd = spark.createDataFrame([("Ä!",), ("",), ("z",)], "cache_key string")
    cache.append(odd.withColumns({"value": F.lit("v"), "ok": F.lit(True), "kept_at": F.current_timestamp(), "run": F.lit("r")}), path)
    assert cache.lookup(spark, path, odd).count() == 3


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "c")
    for word in ("one", "two", "three"):
        through(rows(spark, 0, 30), path, word, force=True)
    before = through(rows(spark, 0, 30), path, "x")[0]
    files = lambda: glob.glob(f"{path}/key_prefix=*/*.parquet")
    n, kept = len(files()), spark.read.parquet(path).count()
    assert cache.compact(spark, path) == n and len(files()) < n
    assert kept > 90 and spark.read.parquet(path).count() == 30
    assert through(rows(spark, 0, 30), path, "y")[0] == before | {k: (f"y {k}", False) for k in (9, 19, 29)}
    assert cache.compact(spark, str(tmp_path / "none")) == 0


def test_a_text_is_kept_once(spark, tmp_path):
    """A cached run leaves one copy of a text in the shared folder and one in the cache, not contents, parts and a second name for the text."""
    from docweave.config import resolve
    from docweave.plans.engine import DocEngine
    from docweave.sources.store import run_folder

    for k in range(20):
        (tmp_path / f"t{k}.md").write_text(f"the very text {k}")
    engine = DocEngine(spark, resolve({}, mode="mock", cache_dir=str(tmp_path / "cache")))
    tables = lambda: {d for d in glob.glob(f"{run_folder(spark)}/*") if glob.glob(f"{d}/*.parquet")}
    copies = lambda *folders: sum(str(r).count("the very text") for d in folders for r in spark.read.parquet(d).collect())
    for hit in (False, True):
        before = tables()
        found = engine.parsed(engine.scan([str(tmp_path)]))
        assert copies(*(tables() - before)) == 20 and copies(str(tmp_path / "cache" / "results")) == 20
        assert {(r["plain"], r["raw"]["full_text"], r["ok"], r["cache_hit"]) for r in found.collect()} == {(t, t, True, hit) for t in (f"the very text {k}" for k in range(20))}


def test_a_file_that_changes_is_an_error(spark, tmp_path):
    """What is parsed must be what was hashed; else a key would keep another content's result."""
    from docweave.sources.scan import parse_files

    (tmp_path / "a.md").write_text("new")
    known = spark.createDataFrame([("k.md", None, str(tmp_path / "a.md"), h) for h in ("no", "11507a0e2f5e69d5dfa40a62a1bd7b6ee57e6bcd85c67c9b8431b36fff21c437")], "path string, content binary, at string, file_hash string")
    assert sorted((r["kind"], r["text"]) for r in parse_files(known).collect()) == [("error", None), ("text", "new")]
