"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: blank, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: The most rows that a table may have to be broadcast (its rows are a few numbers or short strings).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is.

    lower() is far faster than translate(), and gives the same unless the text has letters beyond
    ASCII that have a lower case (or a character of a class that could).
    """
    same = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{M}\p{Nd}\p{P}\p{Z}]")
    return F.when(same, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def let(value: Column, body) -> Column:
    """body(value), where value is computed once and not at each place that names it."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """value, but never moved or repeated by the optimizer: a filter on it stays above it instead of taking a copy of all it is made of."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def bucket_of(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: how the contracts hold rows out."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


#: The tables that stored() wrote and nobody has discarded, oldest first.
_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and what follows reads it as often as it likes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many stored tables there are: a mark for discard()."""
    return len(_written)


def discard(spark: SparkSession, mark: int, keep_last: bool = True) -> None:
    """Deletes the tables stored since the mark, but the last one: for when that is all that is still read."""
    gone = _written[mark : -1 if keep_last else None]
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df as reliable checkpoint, partition by partition as it was computed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough; else joins shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def groups_of_text(rows: Iterable[tuple], size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows whose second field is a text, in lists of about size characters (a longer text is alone)."""
    held, n = [], 0
    for row in rows:
        if held and n + len(row[1]) > size:
            yield held
            held, n = [], 0
        held.append(row)
        n += len(row[1])
    if held:
        yield held


def arrow_rows(batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)
