"""Archive entries: junk, unsafe names, classes, and the order of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.files import archive_path, base_name, file_class


def classify_entries(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Adds kind: junk, unsafe (absolute or with ..), file, text, nested (an archive in an archive), skipped or directory."""
    name = F.col(entry)
    junk = F.startswith(name, F.lit("__MACOSX/")) | F.startswith(base_name(name), F.lit(".DS_Store")) | (base_name(name) == "Thumbs.db")
    unsafe = F.startswith(name, F.lit("/")) | F.contains(name, F.lit("..")) | name.rlike(r"^[A-Za-z]:|\\")
    by_class = F.when(file_class(name) == "archive", "nested").when(file_class(name) == "text", "text").when(file_class(name) == "parse", "file").otherwise("skipped")
    return entries.withColumn("kind", F.when(F.endswith(name, F.lit("/")), "directory").when(junk, "junk").when(unsafe, "unsafe").otherwise(by_class))


def slots(classified: DataFrame, origin: str = "origin", entry: str = "entry") -> DataFrame:
    """The files and texts with sub, their rank by name within their archive, from 1. Names are compared by their bytes."""
    return classified.where(F.col("kind").isin("file", "text")).withColumn("sub", F.row_number().over(Window.partitionBy(origin).orderBy(entry)))


def input_slots(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """paths (origin: the place among the inputs, path) and entries of their archives (path, entry, sub, error_code, error_message) as origin, sub, path, kind (parse, passthrough or archive-failed), error_code, error_message.

    An archive's entries take its place, numbered among those that are files or texts; one that cannot be
    opened is one failed slot.
    """
    opened = classify_entries(entries.where("entry is not null")).where(F.col("kind").isin("file", "text"))
    inside = paths.withColumnRenamed("path", "archive").join(opened.withColumn("archive", archive_path(F.col("path"), F.col("entry"))), "archive")
    inside = inside.withColumn("sub", F.row_number().over(Window.partitionBy("origin").orderBy("entry"))).select("origin", "sub", "path", F.when(F.col("kind") == "text", "passthrough").otherwise("parse").alias("kind"), "error_code", "error_message")
    failed = paths.join(entries.where("entry is null and error_message is not null").select("path", "error_code", "error_message"), "path")
    failed = failed.select("origin", F.lit(0).alias("sub"), "path", F.lit("archive-failed").alias("kind"), "error_code", "error_message")
    of = file_class(F.col("path"))
    own = paths.where(of != "archive").select("origin", F.lit(0).alias("sub"), "path", F.when(of == "text", "passthrough").otherwise("parse").alias("kind"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"))
    return own.unionByName(inside).unionByName(failed)


def archive_summaries(entries: DataFrame) -> DataFrame:
    """Of each opened archive: archive, expanded, passthrough, warnings (of nested archives, which are not opened)."""
    of = classify_entries(entries.where("entry is not null")).withColumn("archive", archive_path(F.col("path"), F.col("entry")))
    warning = F.when(F.col("kind") == "nested", F.concat(F.lit("nested archive "), "entry", F.lit(" was not opened")))
    return of.groupBy("archive").agg(F.count_if(F.col("kind") == "file").alias("expanded"), F.count_if(F.col("kind") == "text").alias("passthrough"), F.array_sort(F.collect_set(warning)).alias("warnings"))
