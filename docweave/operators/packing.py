"""Greedy packing in order, exactly and in parallel: where a batch begins depends on where the last one did.

Jobs of few sources run in order, a job in one task. A job of many is cut into ranges of sources:

1. The ranges' totals, summed up, place every source on one line of characters (prefix sums). A batch that
   begins at s on that line holds all sources that end at s + most or before; the first that ends after it
   begins the next batch. So what one range hands on to the next is one number, the limit s + most.
2. In a range that lies within one job, the limit that comes in can only matter through the first source that
   ends after it: one of those within the first `most` characters. For each of these entries the last batch
   that begins in the range is found by doubling jumps (binary search gives one jump), with the limit that it
   hands on and how many batches began.
3. Each limit handed on is resolved to the entry of a later range, so entries form paths; the entries on the
   path from a job's beginning are marked by doubling the links, in as many rounds as the logarithm of ranges.
4. Each range is numbered in order from the limit and the number that came in.

Nothing depends on the size of a job; tables of the driver have a row a range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweave.operators.ranges import group_of
from docweave.sources.store import checkpointed, stored

#: Sources of a job that one task takes in order, and sources of a range of a larger job.
IN_TASK, RANGE = 1_000_000, 1_000_000


def batch_numbers(sizes: Iterable[int], most: int) -> Iterator[int]:
    """What packing means: for each size in order the batch it falls into, from 1; a new batch begins when this one has something and would grow over `most`."""
    no, used, some = 1, 0, False
    for size in sizes:
        if some and used + size > most:
            no, used = no + 1, 0
        used, some = used + size, True
        yield no


def _within(a: int, b: int, incl, excl, most: int):
    """Of each source of a job in a range, from a to b, the next beginning (b if it is beyond)."""
    import numpy as np

    return np.clip(np.searchsorted(incl[a:b], excl[a:b] + most, side="right") + a, np.arange(a + 1, b + 1), b)


def _followed(at, a: int, b: int, incl, excl, most: int):
    """For batches that begin at the places `at`: the last beginning in the range, and how many there are with the first."""
    import numpy as np

    jump = np.append(_within(a, b, incl, excl, most) - a, b - a)
    last, n = np.append(np.arange(b - a), b - a), np.append(np.ones(b - a, np.int64), 0)
    while (jump < b - a).any():
        last, n, jump = np.where(jump < b - a, last[jump], last), n + n[jump], jump[jump]
    return last[at - a] + a, n[at - a]


def _in_order(rows: DataFrame, order: list[str], schema: T.StructType, most: int, came_in: dict[int, tuple[int, int]]) -> DataFrame:
    """rows (order, __job, __n, __part), sorted within partitions, numbered from what came in: the number of a partition's first batch and the characters that it holds already."""

    def run(batches):
        import pyarrow as pa

        job, some, place = None, False, None
        for batch in batches:
            out = []
            if place is None and len(batch):
                place = batch.column("__part")[0].as_py()
                some, (no, used) = place in came_in, came_in.get(place, (1, 0))
            for now, size in zip(batch.column("__job").to_pylist(), batch.column("__n").to_pylist(), strict=True):
                if job is not None and now != job:
                    no, used, some = 1, 0, False
                job = now
                if some and used + size > most:
                    no, used = no + 1, 0
                used, some = used + size, True
                out.append(no)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in order), pa.array(out, pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)


def _ranges(ordered: DataFrame) -> list[dict]:
    """Of each partition that has rows: part, n, chars, first and last job, begin on the line, and whether its first job comes from before and its last one goes on."""
    # Rows are in order of __job first.
    totals = ordered.groupBy(F.col("__part").alias("part")).agg(F.sum("__n").alias("chars"), F.min("__job").alias("first"), F.max("__job").alias("last"))
    found, begin = sorted((r.asDict() for r in totals.collect()), key=lambda r: r["part"]), 0
    for r, before, after in zip(found, [None, *found], [*found[1:], None], strict=False):
        r["begin"], begin = begin, begin + r["chars"]
        r["from"], r["on"] = before is not None and before["last"] == r["first"], after is not None and after["first"] == r["last"]
        r["through"] = r["from"] and r["on"] and r["first"] == r["last"]
    return found


def _entries(ordered: DataFrame, ranges: list[dict], most: int) -> DataFrame:
    """What ranges hand on: part, node (the end of the entry on the line; null for a job that begins in the range), starts, limit, to (the range that the limit lies in, if it is one of the job all through)."""
    places, ends = {r["part"]: k for k, r in enumerate(ranges)}, [r["begin"] + r["chars"] for r in ranges]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found = [b for b in batches if len(b)]
        if not found or not (r := ranges[place := places[found[0].column("__part")[0].as_py()]])["on"]:
            return
        sizes = np.concatenate([b.column("__n").to_numpy() for b in found])
        incl = r["begin"] + np.cumsum(sizes)
        excl = incl - sizes
        if r["through"]:
            near = np.flatnonzero(excl <= r["begin"] + most)
            at = near[np.diff(incl[near], prepend=-1) > 0]  # of sources that end at one place, the first
            last, starts = _followed(at, 0, len(sizes), incl, excl, most)
            node = pa.array(incl[at], pa.int64())
        else:
            jobs = np.concatenate([b.column("__job").to_numpy() for b in found])
            a = int(np.flatnonzero(jobs != jobs[-1])[-1]) + 1 if (jobs != jobs[-1]).any() else 0
            last, starts = _followed(np.array([a]), a, len(sizes), incl, excl, most)
            node = pa.array([None], pa.int64())
        limit = excl[last] + most
        to = [ranges[k]["part"] if k < len(ranges) and ranges[k]["through"] and ranges[k]["first"] == r["last"] else None for k in np.maximum(np.searchsorted(ends, limit, side="right"), place + 1).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(starts), pa.int32()), node, pa.array(starts, pa.int64()), pa.array(limit, pa.int64()), pa.array(to, pa.int32())], ["part", "node", "starts", "limit", "to"])

    return ordered.mapInArrow(run, "part int, node long, starts long, limit long, to int")


def _came_in(handed: DataFrame, ranges: list[dict]) -> dict[int, tuple[int, int]]:
    """For each range whose first job comes from before: how many batches began so far, and the limit of the last."""
    entry = handed.where("node is not null").select(F.col("part").alias("place"), F.col("node").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("own"), "starts", "limit")
    asks = handed.select(F.col("to").alias("place"), F.col("limit").alias("at"), F.lit(1).alias("asks"), "part", F.col("node").alias("own"), "starts", "limit")
    after = Window.partitionBy("place").orderBy(F.desc("at"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(F.col("place").isNotNull(), F.min(F.when(F.col("asks") == 0, F.col("at"))).over(after))
    found = stored(entry.unionByName(asks).withColumn("next", first).where("asks = 1").select("part", F.col("own").alias("node"), "starts", "limit", F.when(F.col("next").isNotNull(), F.col("place")).alias("next_part"), "next"))
    links = found.where("node is not null").select("part", "node", "next_part", "next", "starts")
    reached = found.where("node is null and next is not null").select(F.col("next_part").alias("part"), F.col("next").alias("node"), F.col("starts").alias("before"))
    while True:
        further = reached.join(links, ["part", "node"]).where("next is not null").select(F.col("next_part").alias("part"), F.col("next").alias("node"), (F.col("before") + F.col("starts")).alias("before"))
        further = stored(further)
        if further.isEmpty():
            break
        reached = stored(reached.unionByName(further))
        over = links.select(F.col("part").alias("next_part"), F.col("node").alias("next"), F.col("next_part").alias("p2"), F.col("next").alias("n2"), F.col("starts").alias("s2"))
        links = stored(links.join(over, ["next_part", "next"]).select("part", "node", F.col("p2").alias("next_part"), F.col("n2").alias("next"), (F.col("starts") + F.col("s2")).alias("starts")))
    on_path = reached.join(found, ["part", "node"]).select("part", (F.col("before") + F.col("starts")).alias("n"), "limit")
    marks = {r["part"]: (r["n"], r["limit"]) for r in on_path.unionByName(found.where("node is null").select("part", F.col("starts").alias("n"), "limit")).collect()}  # at most one a range
    out, now = {}, None
    for r in ranges:
        if r["from"]:
            out[r["part"]] = now
        now = marks.get(r["part"], now if r["through"] else None)
    return out


def numbered(sizes: DataFrame, keys: list[str], order: str, most: int, in_task: int = IN_TASK, in_range: int = RANGE) -> DataFrame:
    """sizes (keys, order, __n) as keys, order, batch_no. order tells a job's sources apart; a null size counts as 0."""
    by = [*keys, order]
    schema = T.StructType([*(sizes.schema[k] for k in by), T.StructField("batch_no", T.IntegerType())])
    rows = sizes.select(*by, group_of(keys).alias("__job"), F.coalesce(F.col("__n").cast("long"), F.lit(0)).alias("__n"))
    large = {r["__job"]: r["n"] for r in rows.groupBy("__job").agg(F.count("*").alias("n")).where(F.col("n") > in_task).collect()}  # each has over in_task sources
    in_one = lambda few: _in_order(few.repartition("__job").sortWithinPartitions("__job", order).withColumn("__part", F.lit(0)), by, schema, most, {})
    if not large:
        return in_one(rows)
    is_large = F.col("__job").isin(list(large))
    spark = sizes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(large.values()) // in_range))
    # The checkpoint holds ranges and order, so that all passes see the same even if an executor is lost.
    ordered = checkpointed(rows.where(is_large).repartitionByRange(parts, "__job", order).sortWithinPartitions("__job", order)).withColumn("__part", F.spark_partition_id())
    ranges = _ranges(ordered)
    came_in = {}
    if any(r["on"] for r in ranges):
        begin = {r["part"]: r["begin"] for r in ranges}
        limits = _came_in(stored(_entries(ordered, ranges, most)), ranges)
        came_in = {part: (n, begin[part] - (limit - most)) for part, (n, limit) in limits.items()}
    return in_one(rows.where(~is_large)).unionByName(_in_order(ordered, by, schema, most, came_in))
