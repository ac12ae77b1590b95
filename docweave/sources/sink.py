"""Files as a sink with a commit: df.write.format("markdown_files").option("journal", folder).mode("append").save().

Rows are (path, content). Tasks write into a hidden folder beside each target, under a name of their own, and
list what they wrote in the journal; the driver's commit renames what the successful attempts listed. So
nothing is to be seen before the whole job has succeeded, a failed or doubled attempt never shows, and what it
left is deleted with the hidden folders, at commit as at abort. A rename within a folder is cheap and whole.

Of rows with the same path one stays. The driver holds one journal name a task; the lists are read one by one.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docweave.sources.store import shared_folder

#: Renames at once.
THREADS = 32
#: Times that an aborted job must find nothing more to delete.
QUIET = 4


def file_system(path: str):
    """pyarrow's file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class InPlace(io.RawIOBase):
    """A file of any store, read where it is asked for; a place before its beginning is an OSError, as readers expect."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)

    def readable(self) -> bool:
        return True

    seekable = readable

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, place: int, whence: int = io.SEEK_SET) -> int:
        place += {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell(), io.SEEK_END: self.file.size()}[whence]
        if place < 0:
            raise OSError("before the beginning")
        return self.file.seek(place)

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


def in_place(path: str) -> io.BufferedReader:
    return io.BufferedReader(InPlace(path), 1 << 18)


def put(path: str, content: bytes) -> None:
    system, inner = file_system(path)
    system.create_dir(inner.rpartition("/")[0] or ".", recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(content)


def replace(path: str, target: str) -> None:
    """Renames, over a file that is there. Done before is done."""
    from pyarrow.fs import FileType

    system, inner = file_system(path)
    to = file_system(target)[1]
    try:
        system.move(inner, to)
    except OSError:
        if system.get_file_info(inner).type == FileType.NotFound:
            return
        system.delete_file(to)
        system.move(inner, to)


def listed(folder: str) -> list[str]:
    from pyarrow import fs

    system, inner = file_system(folder)
    return [f.path for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if f.is_file]


def drop(folder: str) -> bool:
    from pyarrow.fs import FileType

    system, inner = file_system(folder)
    there = system.get_file_info(inner).type != FileType.NotFound
    if there:
        system.delete_dir(inner)
    return there


@dataclass
class Wrote(WriterCommitMessage):
    journal: str


class FileWriter(DataSourceArrowWriter):
    def __init__(self, journal: str):
        self.journal, self.run = journal.rstrip("/"), uuid.uuid4().hex

    def hidden(self, folder: str) -> str:
        return f"{folder}/.docweave-{self.run}"

    def write(self, batches: Iterator) -> Wrote:
        attempt, folders, wrote = uuid.uuid4().hex, {}, []
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                folder, _, _ = path.rpartition("/")
                if folder not in folders:  # noted before the first file, so that it is found even if this task is lost
                    folders[folder] = put(f"{self.journal}/folders/{attempt}-{len(folders)}", folder.encode())
                made = f"{self.hidden(folder)}/{attempt}-{len(wrote)}"
                put(made, content or b"")
                wrote.append((made, path))
        put(name := f"{self.journal}/lists/{attempt}", "\n".join(map(json.dumps, wrote)).encode())
        return Wrote(name)

    def commit(self, messages: list) -> None:
        with ThreadPoolExecutor(THREADS) as threads:
            for m in messages:
                system, inner = file_system(m.journal)
                with system.open_input_stream(inner) as f:
                    moves = [json.loads(line) for line in f.read().decode().splitlines()]
                list(threads.map(lambda x: replace(*x), moves))
        self.clean(set())

    def abort(self, messages: list) -> None:
        folders, quiet = set(), 0
        while quiet < QUIET:  # other tasks are being stopped, and may still write for a moment
            quiet = 0 if self.clean(folders) else quiet + 1
            time.sleep(0.3)

    def clean(self, folders: set[str]) -> bool:
        """Deletes the journal and all that is hidden, in these folders and those that the journal adds; whether there was anything."""
        system, _ = file_system(self.journal)
        for f in listed(f"{self.journal}/folders"):
            with system.open_input_stream(f) as s:
                folders.add(s.read().decode())
        with ThreadPoolExecutor(THREADS) as threads:
            return any([*threads.map(lambda x: drop(self.hidden(x)), folders), drop(self.journal)])


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["journal"])


def commit_files(files: DataFrame) -> None:
    """Writes files (path, content), all or none of them."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    rows.write.format(FileSink.name()).option("journal", shared_folder(spark)).mode("append").save()
