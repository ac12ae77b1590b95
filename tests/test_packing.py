"""Batches of one job in parallel are those in order."""

import random

import pytest

from docweave.operators import packing
from docweave.operators.packing import batch_numbers, numbered


@pytest.mark.parametrize("case", range(6))
def test_parallel_packing(spark, case):
    rnd = random.Random(case)
    size = (lambda: rnd.choice([0, 0, 1, rnd.randint(0, 30), rnd.randint(0, 200)])) if case % 2 else (lambda: rnd.choice([7, 7, 7, 0]))  # equal sizes never fall into step
    jobs = {j: [size() for _ in range(n)] for j, n in enumerate(((900,), (400, 300, 1, 0, 5), (2, 1200))[case % 3])}
    most = (1, 20, 100, 150, 3000, 30)[case]
    rows = [(None if j == 0 else str(j), k, None if n == 0 and k % 2 else n) for j, sizes in jobs.items() for k, n in enumerate(sizes)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "job string, seq int, __n long")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = numbered(df, ["job"], "seq", most, in_task=(0, 3, 350)[case % 3])
        got = {(r["job"], r["seq"]): r["batch_no"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {(None if j == 0 else str(j), k): b for j, sizes in jobs.items() for k, b in enumerate(batch_numbers(sizes, most))}


def test_ranges_that_hold_one_batch_or_none(spark):
    """Batches over many ranges, empty sources at their borders, sources that are larger than a batch."""
    for sizes, most in (([1] * 300, 250), ([0] * 200 + [5] + [0] * 100, 3), ([1000] * 120 + [0] * 60, 7), ([], 5)):
        rows = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "seq int, __n long")
        got = {r["seq"]: r["batch_no"] for r in numbered(rows, [], "seq", most, in_task=0).collect()}
        assert got == dict(enumerate(batch_numbers(sizes, most)))


def test_no_task_has_a_job(spark):
    rows = spark.range(200_000).selectExpr("id AS seq", "(id * 7919) % 50 AS __n")
    sc = spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = numbered(rows, [], "seq", 10_000, in_task=1000)
        share = [n for n in found.select("batch_no").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
        assert len(share) >= 12 and max(share) < 2 * 200_000 / 16
        assert found.selectExpr("max(batch_no)").first()[0] == list(batch_numbers([(k * 7919) % 50 for k in range(200_000)], 10_000))[-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert packing.IN_TASK >= 1000 and sc is not None
