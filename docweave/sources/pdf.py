"""PDF text layers with the standard library.

Reads documents with a classic or a compressed object structure, Flate streams, and the text operators.
Fonts with a ToUnicode map are read by it, others as Latin text. Encrypted documents are refused. A page
that is only an image has an empty layer and is left to OCR.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
REF = rb"(\d+)\s+\d+\s+R"
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]<>()]+|[-+.\d]+|[A-Za-z'\"*]+|<<|>>", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class NoPdf(ValueError):
    pass


class Protected(ValueError):
    """The document is encrypted."""


def _inflate(head: bytes, body: bytes) -> bytes:
    if b"FlateDecode" not in head:
        return body
    try:
        return zlib.decompressobj().decompress(body)
    except zlib.error:
        return b""


class Pdf:
    def __init__(self, content: bytes):
        if b"%PDF-" not in content[:1024]:
            raise NoPdf("no PDF header")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise Protected("the document is encrypted")
        self.objects = {int(n): body for n, _, body in OBJECT.findall(content)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body and (s := STREAM.search(body)):
                head = body[: s.start()]
                data, count, first = _inflate(head, s[1]), int(re.search(rb"/N\s+(\d+)", head)[1]), int(re.search(rb"/First\s+(\d+)", head)[1])
                numbers = list(map(int, data[:first].split()[: 2 * count]))
                starts = [first + x for x in numbers[1::2]] + [len(data)]
                for k, n in enumerate(numbers[::2]):
                    self.objects.setdefault(n, data[starts[k] : starts[k + 1]])
        self.pages = list(self._walk())

    def _walk(self) -> Iterator[tuple[bytes, bytes]]:
        """The pages in order, each with its inherited resources."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        m = root and re.search(rb"/Pages\s+" + REF, root)
        if not m:
            raise NoPdf("no pages")
        seen = set()

        def down(n: int, inherited: bytes):
            if n in seen:
                return
            seen.add(n)
            node = self.objects.get(n, b"")
            kids = re.search(rb"/Kids\s*\[(.*?)\]", node, re.S)
            own = node if b"/Resources" in node else inherited
            if kids:
                for k in re.findall(REF, kids[1]):
                    yield from down(int(k), own)
            else:
                yield node, own

        yield from down(int(m[1]), b"")

    def stream(self, n: int) -> bytes:
        body = self.objects.get(n, b"")
        s = STREAM.search(body)
        return _inflate(body[: s.start()], s[1]) if s else b""

    def _fonts(self, resources: bytes) -> dict[bytes, dict[int, str]]:
        """Of fonts with a ToUnicode map: name to map (key 0 of width: see _map)."""
        m = re.search(rb"/Resources\s+" + REF, resources)
        held = self.objects.get(int(m[1]), b"") if m else resources
        m = re.search(rb"/Font\s+" + REF, held)
        held = self.objects.get(int(m[1]), b"") if m else (re.search(rb"/Font\s*<<(.*?)>>", held, re.S) or [b"", b""])[1]
        out = {}
        for name, n in re.findall(rb"/([^\s/]+)\s+" + REF, held):
            if u := re.search(rb"/ToUnicode\s+" + REF, self.objects.get(int(n), b"")):
                out[name] = _map(self.stream(int(u[1])))
        return out

    def items(self, page: int) -> list[tuple[str, bool]]:
        """The text items of a page (from 0) and whether a line ends after each."""
        node, resources = self.pages[page]
        m = re.search(rb"/Contents\s*(?:\[(.*?)\]|" + REF + rb")", node, re.S)
        refs = re.findall(REF, m[1]) if m and m[1] is not None else [m[2]] if m else []
        data = b"\n".join(self.stream(int(n)) for n in refs)
        fonts, font, stack, out = self._fonts(resources), None, [], []

        def end_line():
            if out:
                out[-1] = (out[-1][0], True)

        for token in TOKEN.findall(data):
            if token[:1] in b"(<[/-+.0123456789" or token == b"]":
                stack.append(token)
                continue
            if token == b"Tf" and len(stack) > 1:
                font = fonts.get(stack[-2][1:])
            elif token in (b"Td", b"TD") and stack and stack[-1] not in (b"0", b"0.0"):
                end_line()
            elif token in (b"T*", b"Tm", b"ET"):
                end_line()
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"'):
                    end_line()
                text = "".join(_decode(x, font) for x in stack if x[:1] in b"(<" and x != b"<<")
                if text:
                    out.append((text, False))
            stack = []
        return out

    def text(self, page: int) -> str:
        return "".join(t + ("\n" if eol else " ") for t, eol in self.items(page) if t).strip()


def _map(cmap: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = text(b)
            out[-1] = str(len(a) // 2)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[-1] = str(len(a) // 2)
            for k in range(int(a, 16), int(z, 16) + 1):
                out[k] = chr(int(b, 16) + k - int(a, 16))
    return out


def _decode(token: bytes, font: dict[int, str] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\(\d{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].strip() == b"" else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if font:
        width = int(font.get(-1, "1"))
        return "".join(font.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width))
    return raw.decode("utf-16", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def pages(content: bytes, wanted=None) -> Iterator[tuple[int, int, str]]:
    """Page number (from 1), number of pages, text layer. wanted(total) says which pages are read; the others are not decoded."""
    pdf = Pdf(content)
    total = len(pdf.pages)
    for no in wanted(total) if wanted else range(1, total + 1):
        yield no, total, pdf.text(no - 1)


def select_pages(total: int, most: int = 10, ratio: tuple[int, int] = (7, 3)) -> list[int]:
    """The pages that functions.files.select_pages names, for a reader that must know them before it decodes any."""
    head = -(-most * ratio[0] // sum(ratio))
    return list(range(1, total + 1)) if total <= most else [*range(1, head + 1), *range(total - (most - head) + 1, total + 1)]


def page_image(pdf: Pdf, page: int, edge: int) -> tuple[bytes, str] | None:
    """The default renderer: a scanned page's own picture (its largest JPEG), None for a page without one. Another renderer with this signature may draw pages."""
    _, resources = pdf.pages[page]
    m = re.search(rb"/Resources\s+" + REF, resources)
    held = pdf.objects.get(int(m[1]), b"") if m else resources
    found = []
    for n in re.findall(REF, (re.search(rb"/XObject\s*<<(.*?)>>", held, re.S) or [b"", b""])[1]):
        body = pdf.objects.get(int(n), b"")
        if b"/DCTDecode" in body and (s := STREAM.search(body)):
            found.append(s[1])
    return (max(found, key=len), "image/jpeg") if found else None
