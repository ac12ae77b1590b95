"""DOCX documents: paragraphs and embedded images, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def raw_text(content: bytes) -> str:
    """The paragraphs with a blank line between, trimmed."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter():
        if _tag(p) == "p":
            out.append("".join((x.text or "") if _tag(x) == "t" else "\t" if _tag(x) == "tab" else "\n" if _tag(x) in ("br", "cr") else "" for x in p.iter()))
    return "\n\n".join(out).strip()


def images(content: bytes) -> Iterator[tuple[int, bytes]]:
    """The embedded images in the order in which the document shows them, from 1. One that cannot be read is left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        try:
            targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
        except KeyError:
            return
        no = 0
        for rel in re.findall(rb'r:(?:embed|id)="([^"]+)"', z.read("word/document.xml")):
            target = targets.get(rel.decode(), "")
            if target.startswith("media/"):
                no += 1
                try:
                    yield no, z.read(f"word/{target}")
                except KeyError:
                    continue
