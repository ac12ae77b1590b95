"""Operator 7, sharding: contiguous balanced shards by prefix sums of bytes.

Rows are put in order of id by range partitioning. Each partition's rows and bytes are added up (as many
numbers as partitions, not rows), their running sums give each partition its place in the whole, and a
row's own place follows within its partition. The line of all bytes is cut at equal targets: a row goes
to the shard that holds the middle of its bytes, so a shard is off its target by at most half a row at
either end. Texts are not moved: size and checksum are taken where a text is read.

Defined results: a null text has no bytes and checksum 0; repeated rows get a slot each; null ids come
first; other columns are left out; an empty table gives an empty result; with fewer rows than shards,
some shards are empty.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import checkpointed, stored, table, text_of

SHARDS = 40
#: Bytes that any row has besides its text.
OVERHEAD = 16


def sizes(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def contiguous_shards(rows: DataFrame, shards: int = SHARDS, order: tuple[str, ...] = ("doc_id", "size", "text_crc32"), size_col: str = "size") -> DataFrame:
    """Adds shard and slot to rows, which have a size; order must tell rows apart as far as they differ. Columns named shard, slot or __place give way."""
    spark = rows.sparkSession
    rows = stored(rows.drop(*(c for c in rows.columns if c.lower() in ("shard", "slot", "__place"))))
    parts = max(1, min(rows.rdd.getNumPartitions() * 4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # The checkpoint holds the partitions and their order, so that both passes below see the same even if an executor is lost.
    ordered = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    totals = {r["part"]: (r["n"], r["bytes"]) for r in ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum(size_col).alias("bytes")).collect()}
    last = max(totals, default=-1) + 1
    before = list(accumulate((totals.get(p, (0, 0)) for p in range(last)), lambda a, b: (a[0] + b[0], a[1] + b[1]), initial=(0, 0)))
    total = before[-1][1]
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("__place", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        at, bytes_before = before[min(TaskContext.get().partitionId(), last)]
        for batch in batches:
            size = batch.column(size_col).to_numpy(zero_copy_only=False)
            ends = bytes_before + np.cumsum(size)
            # Twice the middle of the row's bytes, as a whole number; Python's numbers do not overflow.
            shard = [min(shards - 1, (2 * int(e) - int(s)) * shards // (2 * total)) for e, s in zip(ends, size, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32()), pa.array(np.arange(at, at + len(size)), pa.int64())], [*batch.schema.names, "shard", "__place"])
            at, bytes_before = at + len(size), int(ends[-1]) if len(size) else bytes_before

    placed = stored(ordered.mapInArrow(run, schema))
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("__place").alias("first")).collect()}
    starts = F.array(*(F.lit(first.get(k, 0)).cast("long") for k in range(shards)))
    return placed.withColumn("slot", F.col("__place") - F.get(starts, F.col("shard"))).drop("__place")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, format: str = "parquet") -> None:
    """Writes docs (doc_id, text and others) as folders shard=0 ..., in order of id. The rows themselves are put in order and cut, so no row is lost or doubled by its id. A column named shard gives way to the folders."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() == "shard"))
    text = text_of()
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__size": F.octet_length(text).cast("long") + OVERHEAD, "__crc": F.crc32(text.cast("binary"))})
    placed = contiguous_shards(keyed, shards, ("__id", "__size", "__crc"), "__size")
    placed.select(*docs.columns, "shard").repartitionByRange("shard", "doc_id").sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").format(format).save(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = contiguous_shards(sizes(table(spark, sf_dir, "documents")))
    return assigned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
