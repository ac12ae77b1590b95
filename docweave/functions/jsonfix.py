"""JSON as models write it: strict parsing, and candidates from lenient to repaired.

Spark's JSON functions accept text after a value, so the verdict whether a candidate is JSON is Python's
strict parser, in one Arrow-batched function; what leads up to it are the same steps as columns where a
column can express them.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS, BRACKET = "```", re.compile(r"[\[\]{}]")
#: Marks that open and close strings as models write them.
DOUBLE, SINGLE = "\"\u201c\u201d", "'\u2018\u2019"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
GAP = re.compile(r"\s*")


def _no_constant(name: str):
    raise ValueError(name)


def strict(text: str):
    """The value; ValueError if the text is anything but one JSON value (NaN and infinities are none)."""
    return json.loads(text, parse_constant=_no_constant)


def outermost(text: str) -> str | None:
    """From the first opening bracket to the last closing one."""
    found = [(m.start(), m[0] in "[{") for m in BRACKET.finditer(text)]
    begin = next((place for place, opens in found if opens), len(text))
    end = next((place for place, opens in reversed(found) if not opens), -1)
    return text[begin : end + 1] if begin < end else None


def fenced(text: str) -> str | None:
    """What stands between the first line and the last one, if these are a fence."""
    first, *body, last = text.split("\n") if text.count("\n") > 1 else ("", "")
    return "\n".join(body) if first.startswith(TICKS) and last.rstrip() == TICKS else None


def fenced_anywhere(text: str) -> str:
    """What stands between the first two fences, without the name of the format; empty without two."""
    _, *inside = text.split(TICKS, 2)
    if len(inside) < 2:
        return ""
    named = inside[0][:4].lower() == "json"
    return inside[0][4 if named else 0 :].strip()


def _string(text: str, at: int) -> tuple[str, int]:
    """The string that begins at a mark, as JSON writes it, and where it ends. A plain mark is closed by its like only, a curly one by any of its kind."""
    opened = text[at]
    kind = DOUBLE if opened in DOUBLE else SINGLE
    closing = opened if opened in "\"'" else kind
    out, at = ['"'], at + 1
    while at < len(text) and text[at] not in closing:
        if text[at] == "\\" and at + 1 < len(text):
            out.append(text[at + 1] if text[at + 1] == "'" else text[at : at + 2])
            at += 2
        else:
            out.append('\\"' if text[at] == '"' else text[at])
            at += 1
    return "".join(out) + '"', at + 1


def repaired(text: str) -> str:
    """The text with what models get wrong put right, outside of strings only: other quotes, comments, bare keys, a comma before a closing bracket."""
    out, at, comma, before = [], 0, None, ""  # comma: where out has one that nothing but blanks follow; before: the last sign that counts
    while at < len(text):
        c = text[at]
        if c in DOUBLE or c in SINGLE:
            part, at = _string(text, at)
        elif text.startswith("//", at):
            end = text.find("\n", at)
            part, at = "", len(text) if end < 0 else end
        elif text.startswith("/*", at) and (end := text.find("*/", at)) >= 0:
            part, at = "", end + 2
        elif (m := NAME.match(text, at)) and before in ("{", ",") and text[GAP.match(text, m.end()).end() : GAP.match(text, m.end()).end() + 1] == ":":
            part, at = f'"{m[0]}"', m.end()
        elif m:
            part, at = m[0], m.end()
        else:
            part, at = c, at + 1
        if part in ("}", "]") and comma is not None:
            out[comma] = ""
        if part.strip():
            comma, before = len(out) if part == "," else None, part[-1]
        out.append(part)
    return "".join(out)


def parse_fixing(text: str):
    """The first of these that is JSON: the text, what its fence holds, its outermost brackets, those repaired."""
    inner = text.strip()
    tries = [inner]
    if (body := fenced(inner)) is not None:
        tries.append(inner := body.strip())
    sliced = outermost(inner)
    tries += [x for x in (sliced, repaired(sliced or inner)) if x]
    for t in tries:
        try:
            return strict(t)
        except ValueError:
            continue
    raise ValueError("no JSON in the text")


def parse_lenient(text: str):
    """The older way: the text, a fence anywhere in it, its outermost brackets if something stands before them."""
    raw = text.strip()
    tries = [raw, *([body] if (body := fenced_anywhere(raw)) else [])]
    if (sliced := outermost(raw)) and raw[:1] not in ("{", "["):
        tries.append(sliced)
    for t in tries:
        try:
            return strict(t)
        except ValueError:
            continue
    raise ValueError("no JSON in the text")


def extracted(text: str | None) -> tuple[str, bool]:
    """An object as JSON text, and whether parsing failed: other values come as {"result": value}, what is no JSON as {"text": text}."""
    raw = text or ""
    try:
        value = parse_fixing(raw)
    except ValueError:
        return json.dumps({"text": raw}, ensure_ascii=False, separators=(",", ":")), True
    return json.dumps(value if isinstance(value, dict) else {"result": value}, ensure_ascii=False, separators=(",", ":")), False


def _or_text(replies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extracted(x) for x in replies], columns=["extracted", "parse_failed"])


def json_or_text(replies: Column | str) -> Column:
    """Model replies as struct(extracted, parse_failed); see extracted()."""
    return F.pandas_udf(_or_text, "struct<extracted:string,parse_failed:boolean>")(replies)


def _good(text: str | None) -> bool:
    try:
        strict(text)
    except (ValueError, TypeError):
        return False
    return True


def _all_good(texts: pd.Series) -> pd.Series:
    return texts.map(_good)


def is_json(texts: Column | str) -> Column:
    return F.pandas_udf(_all_good, "boolean")(texts)


def outermost_col(s: Column) -> Column:
    """outermost() as a column; null if there is none."""
    first = lambda c: F.nullif(F.locate(c, s), F.lit(0))
    last = lambda c: F.when(F.contains(s, F.lit(c)), F.char_length(s) - F.locate(c, F.reverse(s)) + 1)
    start, end = F.least(first("{"), first("[")), F.greatest(last("}"), last("]"))
    return F.when(end > start, F.substring(s, start, end - start + 1))
