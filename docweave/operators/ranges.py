"""Order within groups of any size: ranges of rows in order, what each hands on, and then all ranges at once.

A window gives each of its groups to one task. Here rows are put into ranges by group and order, so a large
group lies in many; a range says how much of its first and last group it holds, the driver adds that up (a row
a range), and every range goes on from what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweave.sources.store import checkpointed


def group_of(keys: list[str]) -> Column:
    """A number for equal keys, nulls among them."""
    return F.xxhash64(*(x for k in keys for x in (F.col(k), F.col(k).isNull()))) if keys else F.lit(0).cast("long")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered_within(rows: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """rows with their place among those with the same keys, from 1, in the column: row_number() without a task for each group. Rows alike in keys and order get places in any order."""
    by = ["__group", *order]
    ordered = rows.withColumn("__group", group_of(keys)).repartitionByRange(_parts(rows), *by).sortWithinPartitions(*by)
    # The checkpoint holds ranges and order, so that both passes see the same even if an executor is lost.
    ordered = checkpointed(ordered).withColumn("__part", F.spark_partition_id())
    sizes = ordered.groupBy("__part", "__group").agg(F.count("*").alias("n")).groupBy("__part")
    ends = sizes.agg(F.min("__group").alias("first"), F.max("__group").alias("last"), F.max_by("n", "__group").alias("n"))
    before, last, held = {}, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        before[r["__part"]] = held if r["first"] == last else 0
        held, last = r["n"] + (before[r["__part"]] if r["first"] == r["last"] else 0), r["last"]
    schema, names = T.StructType([*rows.schema.fields, T.StructField(number, T.LongType())]), rows.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, n = None, 0
        for batch in batches:
            if not len(batch):
                continue
            group = batch.column("__group").to_numpy()
            if now is None:
                now, n = group[0], before[batch.column("__part")[0].as_py()]
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group)))) + 1
            if group[0] == now:
                place[: starts[1] if len(starts) > 1 else None] += n
            now, n = group[-1], place[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(place, pa.int64())], schema.names)

    return ordered.mapInArrow(run, schema)


def highest_sum(steps: DataFrame, keys: list[str], at: str, step: str, name: str) -> DataFrame:
    """keys and the highest running sum of step in order of at (a place has one step), without a task for each group: a range gives the sum and the highest sum of each group in it, and those of a group's ranges are put together."""
    by = ["__group", at]
    ordered = steps.withColumn("__group", group_of(keys)).repartitionByRange(_parts(steps), *by).sortWithinPartitions(*by).select(*keys, "__group", F.col(step).cast("long").alias("__step"), F.spark_partition_id().alias("__part"))
    schema = T.StructType([*(steps.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in ("__group", "__part", "__total", "__high"))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None  # the group that may go on in the next batch: its keys, number, range, sum, highest sum

        def given(x):
            return pa.RecordBatch.from_arrays([*x[0], *(pa.array([v], pa.int64()) for v in x[1:])], schema.names)

        for batch in batches:
            if not len(batch):
                continue
            group, sums = batch.column("__group").to_numpy(), batch.column("__step").to_numpy()
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
            for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
                run_ = np.cumsum(sums[a:b])
                if held is not None and held[1] == group[a]:
                    held = (*held[:3], held[3] + int(run_[-1]), max(held[4], held[3] + int(run_.max())))
                    continue
                if held is not None:
                    yield given(held)
                held = ([batch.column(k).slice(a, 1) for k in keys], int(group[a]), batch.column("__part")[0].as_py(), int(run_[-1]), int(run_.max()))
        if held is not None:
            yield given(held)

    parts = ordered.mapInArrow(run, schema)
    so_far = F.coalesce(F.sum("__total").over(Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most a row a range
    return parts.withColumn("__high", F.col("__high") + so_far).groupBy("__group", *keys).agg(F.max("__high").alias(name)).drop("__group")
