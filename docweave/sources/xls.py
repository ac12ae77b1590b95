"""Legacy workbooks (BIFF8): cells and merged ranges, with the standard library."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

from docweave.sources.ole import Compound, compound
from docweave.sources.xlsx import Cell, letters, number_text

# Fixed record numbers of the format.
BOF, EOF, BOUNDSHEET, SST, CONTINUE, FILEPASS = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x2F
LABEL, LABELSST, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING, RSTRING, MERGED = 0x204, 0xFD, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0xD6, 0xE5
#: Rows that a sheet has room for.
ROWS = 65_536
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class Book:
    def __init__(self, content: bytes):
        book = Compound(content)
        self.data = book.stream("Workbook" if "Workbook" in book.entries else "Book")
        self.sheets: list[tuple[str, int]] = []
        self.strings: list[str] = []
        shared: list[bytes] = []
        last = None
        for kind, body in self.records(0):
            if kind == FILEPASS:
                raise ValueError("the workbook is encrypted")
            if kind == BOUNDSHEET:
                at, _, n, wide = struct.unpack_from("<IHBB", body)
                name = body[8 : 8 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1")
                if body[5] == 0:  # a sheet of cells, not a chart or a macro
                    self.sheets.append((name, at))
            elif kind == SST or (kind == CONTINUE and last == SST):
                shared.append(body)
                kind = SST
            last = kind
        if shared:
            self.strings = list(shared_strings(shared))

    def records(self, at: int) -> Iterator[tuple[int, bytes]]:
        """The records from a place to the end of its part."""
        depth = 0
        while at + 4 <= len(self.data):
            kind, n = struct.unpack_from("<HH", self.data, at)
            yield kind, self.data[at + 4 : at + 4 + n]
            at += 4 + n
            depth += (kind == BOF) - (kind == EOF)
            if kind == EOF and depth <= 0:
                return


def shared_strings(blocks: list[bytes]) -> Iterator[str]:
    """The strings of the shared table; a string that goes on in the next record says its width there anew."""
    block, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal block, at
        out = b""
        while n:
            if at >= len(blocks[block]):
                block, at = block + 1, 0
            part = blocks[block][at : at + n]
            out, at, n = out + part, at + len(part), n - len(part)
        return out

    for _ in range(struct.unpack_from("<I", blocks[0], 4)[0]):
        n, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while n:
            if at >= len(blocks[block]):
                block, at = block + 1, 0
                wide = take(1)[0] & 1
            here = min(n, (len(blocks[block]) - at) // (1 + wide))
            text += take(here * (1 + wide)).decode("utf-16-le" if wide else "latin-1")
            n -= here
        take(4 * runs + extra)
        yield text


def _rk(raw: int) -> float:
    value = float(raw >> 2 if raw < 1 << 31 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def _text(body: bytes) -> str:
    n, wide = struct.unpack_from("<HB", body)
    return body[3 : 3 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1")


def _values(book: Book, at: int) -> Iterator[tuple[int, int, str, str, float | None, bool]]:
    """Row, column (from 0), kind, text, number and whether it is a formula's value, as stored."""
    number = lambda x: ("number", number_text(x), x)
    truth = lambda value, is_error: ("string", ERRORS.get(value, "#N/A"), None) if is_error else ("boolean", "true" if value else "false", None)
    waiting = None
    for kind, body in book.records(at):
        if kind in (LABELSST, NUMBER, RK, BOOLERR, LABEL, RSTRING, FORMULA):
            r, c = struct.unpack_from("<HH", body)
        if kind == LABELSST:
            yield r, c, "string", book.strings[struct.unpack_from("<I", body, 6)[0]], None, False
        elif kind == NUMBER:
            yield r, c, *number(struct.unpack_from("<d", body, 6)[0]), False
        elif kind == RK:
            yield r, c, *number(_rk(struct.unpack_from("<I", body, 6)[0])), False
        elif kind == MULRK:
            r, first = struct.unpack_from("<HH", body)
            for k in range((len(body) - 6) // 6):
                yield r, first + k, *number(_rk(struct.unpack_from("<I", body, 6 + 6 * k)[0])), False
        elif kind == BOOLERR:
            yield r, c, *truth(body[6], body[7]), False
        elif kind in (LABEL, RSTRING):
            yield r, c, "string", _text(body[6:]), None, False
        elif kind == FORMULA:
            if body[12:14] != b"\xff\xff":
                yield r, c, *number(struct.unpack_from("<d", body, 6)[0]), True
            elif body[6] == 0:
                waiting = (r, c)
            elif body[6] in (1, 2):
                yield r, c, *truth(body[8], body[6] == 2), True
        elif kind == STRING and waiting:
            yield *waiting, "string", _text(body), None, True
            waiting = None


def cells(content: bytes) -> Iterator[Cell]:
    """Cells that hold something, sheet by sheet, row by row. A formula's cell has its stored value; the formula itself is not read."""
    book = Book(content)
    for no, (name, at) in enumerate(book.sheets, 1):
        for r, c, kind, text, value, _ in sorted(_values(book, at), key=lambda v: v[:2]):
            if text:
                yield Cell(no, name, r + 1, c + 1, f"{letters(c + 1)}{r + 1}", kind, text, value, None)


def sheet_names(content: bytes) -> list[str]:
    return [name for name, _ in Book(content).sheets]


def merged_ranges(content: bytes) -> Iterator[tuple[str, str]]:
    book = Book(content)
    for name, at in book.sheets:
        for kind, body in book.records(at):
            if kind == MERGED:
                for k in range(struct.unpack_from("<H", body)[0]):
                    r1, r2, c1, c2 = struct.unpack_from("<HHHH", body, 2 + 8 * k)
                    yield name, f"{letters(c1 + 1)}{r1 + 1}:{letters(c2 + 1)}{r2 + 1}"


class XlsWriter:
    """A workbook of values written row by row, for tests and fixtures. Its records are held until close() writes the file: strings and the places of sheets stand before the cells."""

    def __init__(self, stream):
        self.stream, self.shared, self.sheets, self.rows, self.merged = stream, {}, {}, {}, {}

    def sheet(self, name: str, merged: list[tuple[int, int, int, int]] = ()) -> bytearray:
        """Begins a sheet, or goes on with it. merged: first row, last row, first column, last column, from 0."""
        if name not in self.sheets:
            self.sheets[name], self.rows[name], self.merged[name] = bytearray(_record(BOF, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0))), 0, merged
        return self.sheets[name]

    def row(self, sheet: str, values: list, merged: list[tuple[int, int, int, int]] = ()) -> None:
        """The next row of a sheet. merged: the ranges of a sheet, as its first row has them."""
        out, r = self.sheet(sheet, merged), self.rows[sheet]
        if r >= ROWS:
            raise ValueError(f"a sheet of a legacy workbook has room for {ROWS} rows")
        for c, v in enumerate(values):
            at = struct.pack("<HHH", r, c, 0)
            if isinstance(v, bool):
                out += _record(BOOLERR, at + bytes([v, 0]))
            elif isinstance(v, int) and abs(v) < 1 << 29:
                out += _record(RK, at + struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF))
            elif isinstance(v, (int, float)):
                out += _record(NUMBER, at + struct.pack("<d", v))
            elif v:
                out += _record(LABELSST, at + struct.pack("<I", self.shared.setdefault(v, len(self.shared))))
        self.rows[sheet] = r + 1

    def close(self) -> None:
        for name, out in self.sheets.items():
            if spans := self.merged[name]:
                out += _record(MERGED, struct.pack("<H", len(spans)) + b"".join(struct.pack("<HHHH", *m) for m in spans))
            out += _record(EOF)
        table = [bytearray(struct.pack("<II", len(self.shared), len(self.shared)))]
        for s in self.shared:  # records hold at most 8,224 bytes; a string begins in a new one if it does not fit
            raw = struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")
            if len(table[-1]) + len(raw) > 8000:
                table.append(bytearray())
            table[-1] += raw
        strings = _record(SST, table[0]) + b"".join(_record(CONTINUE, t) for t in table[1:])
        named = [(n.encode("utf-16-le"), len(n)) for n in self.sheets]
        start = _record(BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
        head = len(start) + sum(4 + 8 + len(raw) for raw, _ in named) + len(strings) + 4
        bounds = b""
        for (raw, n), out in zip(named, self.sheets.values(), strict=True):
            bounds += _record(BOUNDSHEET, struct.pack("<IHBB", head, 0, n, 1) + raw)
            head += len(out)
        self.stream.write(compound({"Workbook": start + bounds + strings + _record(EOF) + b"".join(self.sheets.values())}))


def _record(kind: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def xls(sheets: dict[str, list[list]], merged: dict[str, list[tuple[int, int, int, int]]] | None = None) -> bytes:
    """A workbook of values (for tests and fixtures). merged: first row, last row, first column, last column, from 0."""
    book = XlsWriter(out := io.BytesIO())
    for name, rows in sheets.items():
        book.sheet(name, (merged or {}).get(name, ()))
        for row in rows:
            book.row(name, row)
    book.close()
    return out.getvalue()
