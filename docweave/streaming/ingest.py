"""Incremental ingestion: new rows or files, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.sources.store import shared_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BINARY = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of files with their hash."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).load(folder).withColumn("file_hash", F.sha2("content", 256))


def firsts(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that is first in order, of all that the stream has brought so far: a row of keyed state."""
    return stream.groupBy(key).agg(F.min_by(F.struct(*(c for c in stream.columns if c != key)), order).alias("row")).select(key, "row.*")


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "file_hash", order: str | None = None) -> StreamingQuery:
    """Takes in what is there, each key once, and runs until that is done. What came before is in the state store (RocksDB), so that a micro-batch reads nothing of the target; it appends the rows that are new or now first, as a folder a batch, which a batch that is repeated writes over. taken_in() reads them."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={no}")

    return firsts(stream, key, order or key).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def taken_in(spark: SparkSession, target: str, key: str = "file_hash") -> DataFrame:
    """The rows of target: of each key its last one, which is the first in order of all."""
    kept = spark.read.parquet(target)
    values = F.struct(*(c for c in kept.columns if c not in (key, "batch")))
    return kept.groupBy(key).agg(F.max_by(values, "batch").alias("row")).select(key, "row.*")


def ingest_once(spark: SparkSession, documents: str) -> DataFrame:
    """file_hash and first_doc of a documents table that is read as a stream."""
    work = shared_folder(spark)
    schema = spark.read.parquet(documents).schema
    folder, _, name = documents.rpartition("/")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]").select(F.sha2("text", 256).alias("file_hash"), F.col("doc_id").alias("first_doc"))
    ingest(stream, f"{work}/out", f"{work}/log", order="first_doc").awaitTermination()
    return taken_in(spark, f"{work}/out").select("file_hash", "first_doc")
