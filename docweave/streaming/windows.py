"""Event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.store import shared_folder


def counts(events: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """day, event_type, n of each tumbling window; a window is given out when the watermark has passed it."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """counts() of an events table that is read as a stream to its end; the last window stays open."""
    work = shared_folder(spark)
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = counts(spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]"))
    stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day timestamp, event_type string, n long").parquet(f"{work}/out").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")
