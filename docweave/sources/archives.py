"""ZIP archives: their entries, read in memory and never written next to the archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

#: The most bytes that an entry may unpack to: what a value in an Arrow batch can hold.
MAX_BYTES = (1 << 31) - (1 << 20)


class UnsafeEntry(ValueError):
    """An entry whose name leaves the archive's folder."""


def unsafe(name: str) -> bool:
    return name.startswith("/") or ".." in name or "\\" in name or name[1:2] == ":"


def junk(name: str) -> bool:
    base = name.rsplit("/", 1)[-1]
    return name.startswith("__MACOSX/") or base.startswith(".DS_Store") or base == "Thumbs.db"


def listing(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The entries in order of name, without folders and junk. One unsafe name fails the whole archive, before anything is given out."""
    infos = sorted((i for i in z.infolist() if not i.is_dir() and not junk(i.filename)), key=lambda i: i.filename)
    for i in infos:
        if unsafe(i.filename):
            raise UnsafeEntry(f"unsafe entry name: {i.filename}")
    return infos


def content_of(z: zipfile.ZipFile, info: zipfile.ZipInfo, max_bytes: int = MAX_BYTES) -> tuple[bytes | None, str | None]:
    """An entry's content, or why it has none: an entry that is too large or broken fails alone."""
    if info.file_size > max_bytes:
        return None, f"entry too large: {info.file_size} bytes"
    try:
        return z.read(info), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def entries(content: bytes, max_bytes: int = MAX_BYTES) -> Iterator[tuple[str, bytes | None, str | None]]:
    """Names, contents and errors in order of name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i in listing(z):
            yield i.filename, *content_of(z, i, max_bytes)
