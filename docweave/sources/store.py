"""The cluster's shared folder: tables that are read more than once, and files that tasks write."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/docweave"


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps what it stores on its way."""
    return f"{shared_root(spark)}/docweave-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new name in the application's part of the shared folder."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes what the application stored on its way; for when all results are written."""
    there, system = hadoop_path(spark, run_folder(spark))
    system.delete(there, True)


#: A codec for tables that hold whole texts.
DENSE = "zstd"
#: Where this thread stored tables, in order; None for those that are gone.
_stored = threading.local()


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and not lost with an executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path, compression=codec)
    _stored.paths = [*getattr(_stored, "paths", ()), path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables this thread has stored: a mark for discard()."""
    return len(getattr(_stored, "paths", ()))


def discard(spark: SparkSession, first: int, last: int) -> None:
    """Deletes the tables that this thread stored from one mark to another, which nothing reads any more."""
    for k in range(first, last):
        if _stored.paths[k] is not None:
            there, system = hadoop_path(spark, _stored.paths[k])
            system.delete(there, True)
            _stored.paths[k] = None


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: like stored(), but its partitions and their order are kept."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(run_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    there, system = hadoop_path(spark, path)
    return system.exists(there)


def write_file(path: str, content: bytes, made_folders: set[str]) -> None:
    """Whole or not at all: a file of another name first, then the name. A task that runs again writes the same. made_folders: those that the task has made."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    folder = inner.rpartition("/")[0]
    if folder and folder not in made_folders:
        system.create_dir(folder, recursive=True)
        made_folders.add(folder)
    made = f"{folder}/.{uuid.uuid4().hex}" if folder else f".{uuid.uuid4().hex}"
    with system.open_output_stream(made) as out:
        out.write(content)
    system.move(made, inner)


def write_files(files: DataFrame) -> DataFrame:
    """Writes files (path, content) from the tasks that have them; gives path, size of each. Lazy: what it gives must be asked for."""

    def run(batches):
        import pyarrow as pa

        folders: set[str] = set()
        for batch in batches:
            paths, sizes = batch.column("path").to_pylist(), []
            for path, content in zip(paths, batch.column("content"), strict=True):
                data = content.as_py() or b""
                write_file(path, data, folders)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return files.select(F.col("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, size long")
