"""Legacy Word documents: the body's text by its piece table, with the standard library."""

from __future__ import annotations

import re
import struct

from docweave.sources.ole import Compound, compound

#: What a field shows stands between its separator and its end; its instruction before that is no text.
FIELD = re.compile("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x15]*))?\x15")
ENCRYPTED = 0x100


def raw_text(content: bytes) -> str:
    """The paragraphs of the body with a blank line between, trimmed."""
    book = Compound(content)
    main = book.stream("WordDocument")
    if struct.unpack_from("<H", main)[0] != 0xA5EC:
        raise ValueError("no Word document")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & ENCRYPTED:
        raise ValueError("the document is encrypted")
    table = book.stream("1Table" if flags & 0x200 else "0Table")
    n_body = struct.unpack_from("<I", main, 0x4C)[0]
    at, length = struct.unpack_from("<II", main, 0x1A2)
    clx, k = table[at : at + length], 0
    while k < len(clx) and clx[k] == 1:  # properties come before the pieces
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    if k >= len(clx) or clx[k] != 2:
        raise ValueError("no piece table")
    size = struct.unpack_from("<I", clx, k + 1)[0]
    pieces, n = clx[k + 5 : k + 5 + size], (size - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", pieces)
    text = ""
    for p in range(n):
        start = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * p + 2)[0]
        count = places[p + 1] - places[p]
        if start & 0x40000000:
            start = (start & 0x3FFFFFFF) // 2
            text += main[start : start + count].decode("cp1252", "replace")
        else:
            text += main[start : start + 2 * count].decode("utf-16-le", "replace")
    text = text[:n_body]
    while FIELD.search(text):
        text = FIELD.sub(lambda m: m[1] or "", text)
    text = text.replace("\x0b", "\n").replace("\x07", "\t").replace("\x1e", "-").replace("\xa0", " ")
    paragraphs = re.sub("[\x00-\x08\x0e-\x1f]", "", text.replace("\x0c", "\r")).split("\r")
    return "\n\n".join(paragraphs).strip()


def doc(paragraphs: list[str]) -> bytes:
    """A document (for tests and fixtures): one piece of two bytes a character."""
    text = "\r".join(paragraphs) + "\r"
    start = 1024
    main = bytearray(start)
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 10, 0x200)
    struct.pack_into("<I", main, 0x4C, len(text))
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, start, 0)
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(main) + text.encode("utf-16-le"), "1Table": clx})
