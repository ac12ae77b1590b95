"""Results by content: look up, compute what is missing, keep.

The cache is a Parquet table in a folder for each prefix of the key. A lookup reads the folders of the asked
keys alone (partition pruning), and of their files the row groups that may hold one: files are in order of the
key and carry a Bloom filter of their keys, which the reader asks where the keys are few (many random keys are
in all folders anyway). Rows are appended; compaction leaves the
latest row of each key. Readers take the latest row too, so both see the same before, while and after.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.store import DENSE, discard, exists, hadoop_path, stored, written

#: Leading characters of a key that name its folder, and the folder's column.
PREFIX, FOLDER = 1, "key_prefix"
#: The most keys that a filter on the scan names, so that Bloom filters are asked; more are joined alone.
NAMED = 10


def folder_of(key: Column) -> Column:
    """The folder of a key; keys of digits and letters make names of their own, others share one. Names are no numbers, so Spark does not read them as such."""
    start = F.left(key, F.lit(PREFIX))
    return F.when(start.rlike("^[0-9a-z]+$"), F.concat(F.lit("k"), start)).otherwise("other")


def split_by_cache(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """rows that the cache has (with its columns; one row a key), and rows that it lacks."""
    return rows.join(cache, key), rows.join(cache.select(key), key, "left_anti")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "cache_key") -> DataFrame:
    """The rows that are kept for the keys (one column, distinct), all of them, from the folders of these keys."""
    folders = [r[0] for r in keys.select(folder_of(F.col(key))).distinct().collect()]  # as many as there are prefixes, at most
    kept = spark.read.parquet(path).where(F.col(FOLDER).isin(folders)).drop(FOLDER)
    few = [r[0] for r in keys.select(key).limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        kept = kept.where(F.col(key).isin(few))
    return kept.join(keys, key, "left_semi")


def append(rows: DataFrame, path: str, key: str = "cache_key") -> None:
    """Keeps rows, a file a folder, in order of the key and with a Bloom filter of them."""
    filed = rows.withColumn(FOLDER, folder_of(F.col(key))).repartition(FOLDER).sortWithinPartitions(FOLDER, key)
    filed.write.mode("append").partitionBy(FOLDER).option("compression", DENSE).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def latest(kept: DataFrame, key: str = "cache_key") -> DataFrame:
    """The latest row of each key."""
    values = [c for c in kept.columns if c != key]
    return kept.groupBy(key).agg(F.max_by(F.struct(*values), F.struct("kept_at", "run")).alias("v")).select(key, "v.*")


def compact(spark: SparkSession, path: str, key: str = "cache_key") -> int:
    """Leaves the latest row of each key; the number of files that went.

    The new files come first, then the files that they replace go: a reader meets both for a moment, which
    changes nothing, and if this run is lost between, the next one does the rest. Rows that others append
    meanwhile stay. A reader that listed its files before they went has to begin again.
    """
    if not exists(spark, path):
        return 0
    kept = spark.read.parquet(path)
    old = kept.inputFiles()
    append(latest(stored(kept).drop(FOLDER), key), path, key)
    for name in old:
        there, system = hadoop_path(spark, name)
        system.delete(there, False)
    return len(old)


def through_cache(rows: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "cache_key", force: bool = False, good: Column | None = None) -> DataFrame:
    """compute(rows) with what an earlier run kept at path (the latest row of a key wins), and cache_hit.

    compute gives key and result columns, one row a key; it sees each key once. What is new is appended; of
    an earlier run only rows that are good (all without a condition) are hits, so a failed call is made again.
    If the cache cannot be written, what was computed is given all the same, with cache_failed true. A
    result's file columns are the caller's to join again, so a hit shows the name of this run's file and not
    that of an earlier one. What compute stored on its way is deleted when its result is stored.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    good = F.lit(True) if good is None else good
    earlier = None
    if not force and exists(spark, path):
        earlier = stored(latest(lookup(spark, path, stored(rows.select(key).distinct()), key).where(good), key), DENSE)
    todo = (rows if earlier is None else split_by_cache(rows, earlier.select(key), key)[1]).dropDuplicates([key])
    begun, computed = written(), compute(todo).withColumns({"kept_at": F.current_timestamp(), "run": F.lit(run)})
    done, new, failed = written(), stored(computed, DENSE), False
    discard(spark, begun, done)
    try:
        append(new, path, key)
    except Exception:
        failed = True
    found = new.withColumn("cache_hit", F.lit(False))
    if earlier is not None:
        found = found.unionByName(earlier.withColumn("cache_hit", F.lit(True)))
    values = [c for c in new.columns if c not in (key, "kept_at", "run")]
    return found.select(key, *values, "cache_hit", F.lit(failed).alias("cache_failed"))
