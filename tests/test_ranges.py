"""Numbers and running sums within groups that lie in many ranges."""

import random
import time
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from docweave.functions.vendor import grid_markdown
from docweave.operators import metrics
from docweave.operators.ranges import highest_sum, numbered_within
from docweave.streaming.ingest import ingest, taken_in


@pytest.mark.parametrize("sizes", [(500,), (3, 400, 1, 120), (1,) * 60, ()])
def test_numbers(spark, sizes):
    rnd = random.Random(1)
    rows = [(None if g == 0 else f"g{g}", k // 2, f"x{k}") for g, n in enumerate(sizes) for k in range(n)]  # ties in twos
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, x string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = [tuple(r) for r in numbered_within(df, ["g"], ["k", "x"], "no").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, seen = [], defaultdict(int)
    for g, k, x in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        seen[g] += 1
        want.append((g, k, x, seen[g]))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_names_lie_in_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = numbered_within(spark.range(300_000).withColumn("name", F.lit("same")), ["name"], ["id"], "no")
        assert out.where("no <> id + 1").count() == 0
        share = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(share) >= 12 and max(share) < 2 * 300_000 / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_peak(calls):
    edges = sorted((t, d) for a, ms in calls for t, d in ((a, 1), (a + max(ms, 1), -1)))
    now = peak = 0
    for _, d in edges:
        now += d
        peak = max(peak, now)
    return peak


@pytest.mark.parametrize("keys", [["g"], []])
def test_peaks(spark, keys):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", None, "b"]), rnd.randint(0, 3000), rnd.choice([0, 1, 5, 900])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, started_ms long, ms long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r["g"] if keys else "all": r["peak"] for r in metrics.peak_in_flight(df, keys).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = defaultdict(list)
    for g, a, ms in rows:
        groups[g if keys else "all"].append((a, ms))
    assert got == {g: plain_peak(c) for g, c in groups.items()}
    arrays = df.groupBy("g").agg(F.collect_list(F.struct("started_ms", "ms")).alias("calls")).select("g", metrics.peak_of(F.col("calls")).alias("peak"))
    if keys:
        assert {r["g"]: r["peak"] for r in arrays.collect()} == got


def test_sums_that_stay_below_nothing(spark):
    df = spark.createDataFrame([(k, -1) for k in range(50)], "at int, d int")
    assert highest_sum(df, [], "at", "d", "high").first()["high"] == -1


def test_large_grid(spark):
    """200 x 200 cells in a moment, with the cells in any order and some places twice."""
    rnd = random.Random(3)
    cells = [(r, c, f"t{r}.{c}") for r in range(200) for c in range(200) if (r + c) % 3]
    shuffled = [(r, c, "early") for r, c, _ in cells[:50]] + rnd.sample(cells, len(cells))
    df = spark.createDataFrame([([{"r": r, "c": c, "text": t} for r, c, t in shuffled],)], "cells array<struct<r:int,c:int,text:string>>")
    df.select(grid_markdown(F.col("cells"))).collect()
    began = time.monotonic()
    lines = df.select(grid_markdown(F.col("cells")).alias("m")).first()["m"].split("\n")
    assert time.monotonic() - began < 8
    at = {(r, c): t for r, c, t in cells}
    want = ["| " + " | ".join(at.get((r, c), f"Column {c + 1}" if r == 0 else "") for c in range(200)) + " |" for r in range(200)]
    assert lines == [want[0], "| " + " | ".join(["---"] * 200) + " |", *want[1:]]


def test_ingestion_in_steps_and_after_a_stop(spark, tmp_path):
    """One file a micro-batch, smaller ids later, a new start in the middle: the first of all, and no batch reads the target."""
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    parts = [[("a", 5), ("b", 7)], [("a", 3), ("c", 9)], [("b", 8), ("a", 4)], [("c", 1), ("d", 2), ("d", 2)]]

    def add(rows):
        spark.createDataFrame(rows, "h string, doc long").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema("h string, doc long").option("maxFilesPerTrigger", 1).parquet(src)
        query = ingest(stream, out, log, "h", "doc")
        query.awaitTermination()
        return query

    for rows in parts[:2]:
        add(rows)
    first = run()
    assert {r["h"]: r["doc"] for r in taken_in(spark, out, "h").collect()} == {"a": 3, "b": 7, "c": 9}
    for rows in parts[2:]:
        add(rows)
    again = run()
    assert {r["h"]: r["doc"] for r in taken_in(spark, out, "h").collect()} == {"a": 3, "b": 7, "c": 1, "d": 2}
    assert len(first.recentProgress) >= 2 and again.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    run()  # nothing new
    assert taken_in(spark, out, "h").count() == 4
