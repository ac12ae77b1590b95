"""XLSX workbooks: cells and merged ranges, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree as ET

REF = re.compile(r"([A-Z]+)(\d+)\Z")


class Cell(NamedTuple):
    sheet_no: int
    sheet: str
    row_no: int
    col_no: int
    ref: str
    kind: str  # number, boolean or string
    text: str
    number: float | None
    formula: str | None


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ET.Element) -> str:
    """Of a rich text; phonetic hints do not count."""
    return "".join(x.text or "" for part in e for x in ([part] if _tag(part) == "t" else part if _tag(part) == "r" else []) if _tag(x) == "t")


def column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and parts, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter():
        if _tag(s) == "sheet":
            target = targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
            out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out, top = [], None
    with z.open("xl/sharedStrings.xml") as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            top = e if top is None else top
            if event == "end" and _tag(e) == "si":
                out.append(_text(e))
                top.clear()  # what was read does not stay
    return out


def sheet_cells(z: zipfile.ZipFile, shared: list[str], sheet_no: int, name: str, part: str, columns: set[int] | None = None, last_row: float = float("inf")) -> Iterator[Cell]:
    """A sheet's cells that hold something, row by row; one row is in memory at a time. Cells of other columns are passed over before their text is made."""
    row_no, rows = 0, None
    with z.open(part) as f:
        for event, row in ET.iterparse(f, ("start", "end")):
            if event == "start":
                rows = row if _tag(row) == "sheetData" else rows
                continue
            if _tag(row) != "row":
                continue
            row_no, col_no = int(row.get("r", row_no + 1)), 0
            if row_no > last_row:
                return
            for c in row:
                m = REF.match(c.get("r", ""))
                col_no = column(m[1]) if m else col_no + 1
                if columns is not None and col_no not in columns:
                    continue
                parts = {_tag(x): x for x in c}
                value, kind, number = parts["v"].text if "v" in parts else None, "string", None
                t = c.get("t", "n")
                if t == "s" and value is not None:
                    value = shared[int(value)]
                elif t == "inlineStr":
                    value = _text(parts["is"]) if "is" in parts else None
                elif t == "b" and value is not None:
                    value, kind = ("true" if value == "1" else "false"), "boolean"
                elif t == "n" and value is not None:
                    number, kind = float(value), "number"
                    value = number_text(number)
                if value:
                    yield Cell(sheet_no, name, row_no, col_no, f"{letters(col_no)}{row_no}", kind, value, number, parts["f"].text if "f" in parts else None)
            rows.clear()


def cells(content: bytes) -> Iterator[Cell]:
    """Cells that hold something, sheet by sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = shared_strings(z)
        for sheet_no, (name, part) in enumerate(sheets(z), 1):
            yield from sheet_cells(z, shared, sheet_no, name, part)


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [name for name, _ in sheets(z)]


def merged_ranges(content: bytes) -> Iterator[tuple[str, str]]:
    """Sheet names and ranges."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name, part in sheets(z):
            rows = None
            with z.open(part) as f:
                for event, e in ET.iterparse(f, ("start", "end")):
                    if event == "start":
                        rows = e if _tag(e) == "sheetData" else rows
                    elif _tag(e) == "row":
                        rows.clear()
                    elif _tag(e) == "mergeCell":
                        yield name, e.get("ref")


def full_text(found: Iterator[Cell]) -> str:
    return "\n".join(f"{c.sheet}!{c.ref}: {c.text}" for c in found)
