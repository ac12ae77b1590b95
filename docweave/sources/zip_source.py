"""ZIP archives as a source that is planned by entries: spark.read.format("zip_archives").

The driver looks at the archives' sizes alone. Archives of less than a task's bytes are put together, several a
partition; of a larger one the directory at its end is read, and ranges of its entries become partitions. A
task opens its archive in place and reads the directory and its own entries, nothing else, so an archive may be
of any size. With the option entry, a pattern of names (*, ?, [...]), other entries are never read; an archive that
cannot be opened is a row all the same. (The filters of a query are not taken over: Spark 4.1 keeps what was
pushed with the source, so that a frame that is used again without its filter would miss rows.)
"""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docweave.functions import files
from docweave.sources import archives
from docweave.sources.sink import in_place

SCHEMA = "path string, origin string, entry string, sub int, content binary, file_hash string, length long, error_code string, error_message string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Compressed bytes of a partition, and directories that the driver reads at once.
TASK_BYTES, THREADS = 64 << 20, 32


@dataclass
class Entries(InputPartition):
    """Ranges of entries (archive, from, to; to is None for all), or archives that failed already."""

    ranges: list[tuple[str, int, int | None]]

    def __post_init__(self):
        super().__init__(self.ranges)


def opened(path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(in_place(path))


class ZipReader(DataSourceReader):
    def __init__(self, found: list[tuple[str, int]], task_bytes: int, entry: str | None):
        self.found, self.task_bytes, self.entry = found, task_bytes, entry

    def asked(self, name: str) -> bool:
        return self.entry is None or fnmatchcase(name, self.entry)

    def split(self, path: str) -> list[Entries]:
        """A large archive's partitions; one that cannot be opened fails in its task."""
        try:
            with opened(path) as z:
                sizes = [i.compress_size if self.asked(i.filename) else 0 for i in archives.listing(z)]
        except Exception:
            return [Entries([(path, 0, None)])]
        out, begin, held = [], 0, 0
        for k, size in enumerate(sizes):
            if size and held and held + size > self.task_bytes:
                out.append(Entries([(path, begin, k)]))
                begin, held = k, 0
            held += size
        return [*out, Entries([(path, begin, len(sizes))])]

    def partitions(self) -> list[Entries]:
        out, held, size_held = [], [], 0
        for path, size in self.found:
            if size < self.task_bytes:
                if held and size_held + size > self.task_bytes:
                    out.append(Entries(held))
                    held, size_held = [], 0
                held.append((path, 0, None))
                size_held += size
        with ThreadPoolExecutor(THREADS) as threads:
            large = [p for parts in threads.map(self.split, [p for p, size in self.found if size >= self.task_bytes]) for p in parts]
        return [*out, *([Entries(held)] if held else []), *large]

    def read(self, partition: Entries) -> Iterator:
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string())

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], NAMES)

        for path, begin, end in partition.ranges:
            try:
                z = opened(path)
                infos = archives.listing(z)
            except Exception as e:
                yield row(path, path, None, 0, None, None, None, files.UNSUPPORTED, str(e))
                continue
            with z:
                for k, info in enumerate(infos[begin:end], begin + 1):  # one entry is unpacked at a time
                    if self.asked(info.filename):
                        data, error = archives.content_of(z, info)
                        digest = hashlib.sha256(data).hexdigest() if data is not None else None
                        yield row(f"{path}!{info.filename}", path, info.filename, k, data, digest, None if data is None else len(data), files.UNSUPPORTED if error else None, error)


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader([tuple(x) for x in json.loads(self.options["found"])], int(self.options.get("task_bytes", TASK_BYTES)), self.options.get("entry"))


def archives_at(spark: SparkSession, *paths: str) -> list[tuple[str, int]]:
    """Names and sizes of the archives at the paths (files or folders); the driver is given those of archives alone."""
    from docweave.sources.scan import listed

    return sorted((r["path"], r["length"]) for r in listed(spark, *paths, pattern="*.[zZ][iI][pP]").toLocalIterator())


def read_archives(spark: SparkSession, found: list[tuple[str, int]], task_bytes: int = TASK_BYTES, entry: str | None = None) -> DataFrame:
    """The entries of the archives, of some names if a pattern is given: SCHEMA, as expand_archives() gives them."""
    spark.dataSource.register(ZipSource)
    options = {"found": json.dumps(found), "task_bytes": str(task_bytes)} | ({"entry": entry} if entry else {})
    return spark.read.format(ZipSource.name()).options(**options).load()
