"""Workbooks as a source: spark.read.format("xlsx_cells").load(file), or option "found" with many (a JSON list).

A partition is a sheet. Its task reads the sheet's part of the workbook and the shared texts, row by row, and
gives cells on in batches. Options say what is asked for: sheets (a JSON list; others are no partitions), columns
(A,C,AB; other cells are passed over before their texts are made) and last_row (what follows is not read). The
filters of a query are not taken over: Spark 4.1 keeps what was pushed with the source, so that a frame that is
used again without its filter would miss rows.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docweave.sources import xlsx
from docweave.sources.sink import in_place

SCHEMA = "path string, sheet string, row_no int, col_no int, ref string, value_type string, text string, formula string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Cells of a batch, and workbooks whose sheets the driver lists at once.
BATCH, THREADS = 10_000, 32


@dataclass
class Sheet(InputPartition):
    path: str
    no: int
    name: str
    part: str

    def __post_init__(self):
        super().__init__(self.path)


class XlsxReader(DataSourceReader):
    def __init__(self, paths: list[str], sheets: list[str] | None, columns: set[int] | None, last_row: float):
        self.paths, self.sheets, self.columns, self.last_row = paths, sheets, columns, last_row

    def sheets_of(self, path: str) -> list[Sheet]:
        with zipfile.ZipFile(in_place(path)) as z:
            return [Sheet(path, no, name, part) for no, (name, part) in enumerate(xlsx.sheets(z), 1) if self.sheets is None or name in self.sheets]

    def partitions(self) -> list[Sheet]:
        with ThreadPoolExecutor(THREADS) as threads:
            return [s for found in threads.map(self.sheets_of, self.paths) for s in found] or [Sheet("", 0, "", "")]

    def read(self, partition: Sheet) -> Iterator:
        import pyarrow as pa

        if not partition.no:
            return
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
        with zipfile.ZipFile(in_place(partition.path)) as z:
            found = xlsx.sheet_cells(z, xlsx.shared_strings(z), partition.no, partition.name, partition.part, self.columns, self.last_row)
            while cells := [(partition.path, c.sheet, c.row_no, c.col_no, c.ref, c.kind, c.text, c.formula) for c in islice(found, BATCH)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*cells, strict=True), kinds, strict=True)], NAMES)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> XlsxReader:
        found, sheets, columns, last_row = (self.options.get(k) for k in ("found", "sheets", "columns", "last_row"))
        asked = {xlsx.column(c.strip()) for c in columns.split(",")} if columns else None
        return XlsxReader(json.loads(found) if found else [self.options["path"]], json.loads(sheets) if sheets else None, asked, float(last_row or "inf"))
