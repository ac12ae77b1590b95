"""Small workbooks, documents, PDFs, archives and images, written with the standard library."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

SHEET_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL_NS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PACKAGE_NS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
WORD_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(entries: dict[str, str | bytes]) -> bytes:
    """The same bytes for the same entries, whenever they are written."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def xlsx(sheets: dict[str, list[list]], merged: dict[str, list[str]] | None = None) -> bytes:
    """sheets: name to rows of values (None and '' leave a cell out)."""
    from docweave.sources.xlsx import letters

    parts = _workbook(list(sheets))
    shared: dict[str, int] = {}
    for k, (name, rows) in enumerate(sheets.items(), 1):
        body = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row, 1):
                ref = f"{letters(c)}{r}"
                if isinstance(v, bool):
                    cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, (int, float)):
                    cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                elif v:
                    cells.append(f'<c r="{ref}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>')
            body.append(f'<row r="{r}">{"".join(cells)}</row>')
        spans = "".join(f'<mergeCell ref="{m}"/>' for m in (merged or {}).get(name, ()))
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {SHEET_NS}><sheetData>{''.join(body)}</sheetData>" + (f"<mergeCells>{spans}</mergeCells>" if spans else "") + "</worksheet>"
    parts["xl/sharedStrings.xml"] = f"<sst {SHEET_NS}>" + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared) + "</sst>"
    return zipped(parts)


class XlsxWriter:
    """A workbook written row by row to a stream, sheet after sheet; texts stand in their cells, so no table of them is held."""

    def __init__(self, stream):
        self.zip, self.names, self.part, self.tail, self.n = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), [], None, "", 0

    def row(self, sheet: str, values: list, merged: list[str] = ()) -> None:
        """The next row of a sheet; another name than before begins the next sheet. merged: the ranges of a sheet, as its first row has them."""
        from docweave.sources.xlsx import letters

        if not self.names or self.names[-1] != sheet:
            self._end()
            self.names.append(sheet)
            part = zipfile.ZipInfo(f"xl/worksheets/sheet{len(self.names)}.xml")
            part.compress_type = zipfile.ZIP_DEFLATED
            self.part, self.n = self.zip.open(part, "w", force_zip64=True), 0
            self.part.write(f"<worksheet {SHEET_NS}><sheetData>".encode())
            spans = "".join(f'<mergeCell ref="{m}"/>' for m in merged)
            self.tail = "</sheetData>" + (f"<mergeCells>{spans}</mergeCells>" if spans else "") + "</worksheet>"
        self.n += 1
        cells = []
        for c, v in enumerate(values, 1):
            ref = f"{letters(c)}{self.n}"
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif v:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
        self.part.write(f'<row r="{self.n}">{"".join(cells)}</row>'.encode())

    def _end(self) -> None:
        if self.part is not None:
            self.part.write(self.tail.encode())
            self.part.close()

    def close(self) -> None:
        self._end()
        for name, data in _workbook(self.names).items():
            self.zip.writestr(zipfile.ZipInfo(name), data)
        self.zip.close()


def _workbook(names: list[str]) -> dict[str, str]:
    """The parts that name a workbook's sheets."""
    return {
        "xl/workbook.xml": f"<workbook {SHEET_NS} {REL_NS}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f"<Relationships {PACKAGE_NS}>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>",
    }


def docx(paragraphs: list[str], images: list[bytes] = ()) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    shown = "".join(f'<w:p><w:r><w:drawing><a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" r:embed="rId{k}"/></w:drawing></w:r></w:p>' for k in range(1, len(images) + 1))
    parts: dict[str, str | bytes] = {"word/document.xml": f"<w:document {WORD_NS} {REL_NS}><w:body>{body}{shown}</w:body></w:document>"}
    if images:
        parts["word/_rels/document.xml.rels"] = f"<Relationships {PACKAGE_NS}>" + "".join(f'<Relationship Id="rId{k}" Target="media/image{k}.png"/>' for k in range(1, len(images) + 1)) + "</Relationships>"
        parts |= {f"word/media/image{k}.png": data for k, data in enumerate(images, 1)}
    return zipped(parts)


def pdf(pages: list[str], compress: bool = True, images: dict[int, bytes] | None = None) -> bytes:
    """pages: a text each, in the characters of code page 1252. images: of a page (from 0), as JPEG."""
    n, images = len(pages), images or {}
    out = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * k} 0 R' for k in range(n))}] /Count {n} >>".encode()]
    extra = []
    for k, text in enumerate(pages):
        shown = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").replace("\r", "\\r").encode("cp1252", "replace")
        body = b"BT /F1 12 Tf 72 700 Td (" + shown + b") Tj ET" if text else b""
        data, head = (zlib.compress(body), b"/Filter /FlateDecode ") if compress else (body, b"")
        resources = ""
        if k in images:
            resources = f" /Resources << /XObject << /Im0 {3 + 2 * n + len(extra)} 0 R >> >>"
            extra.append(f"<< /Type /XObject /Subtype /Image /Filter /DCTDecode /Length {len(images[k])} >>\nstream\n".encode() + images[k] + b"\nendstream")
        out.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R{resources} >>".encode())
        out.append(b"<< " + head + b"/Length " + str(len(data)).encode() + b" >>\nstream\n" + data + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(f"{k} 0 obj\n".encode() + o + b"\nendobj\n" for k, o in enumerate([*out, *extra], 1)) + b"%%EOF"


def png(width: int, height: int, rows: bytes | None = None, channels: int = 3) -> bytes:
    """An image of 8 bits a channel; black without rows (height * width * channels bytes)."""
    line = width * channels
    raw = rows if rows is not None else bytes(line * height)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + raw[k * line : (k + 1) * line] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
