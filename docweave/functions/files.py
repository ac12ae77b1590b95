"""Files: formats, classes, names, hashes, keys, cell addresses, page selection."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
FORMATS = {".pdf": "pdf", ".jpg": "jpg", ".jpeg": "jpg", ".png": "png", ".xlsx": "xlsx", ".xls": "xls", ".doc": "doc", ".docx": "docx"}
TEXT_EXTENSIONS = (".md", ".markdown", ".txt")
ARCHIVE_EXTENSION = ".zip"
UNSUPPORTED = "ERR_UNSUPPORTED_FORMAT"
PAGE_RATIO, MAX_PAGES = (7, 3), 10
CHARS_PER_PAGE = 500
FILE_CONCURRENCY = 20


def extension(path: Column) -> Column:
    """In lower case, with the dot; empty for none and for names that start with their only dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def detect_format(path: Column) -> Column:
    """One of the formats, or null."""
    ext, out = extension(path), F.lit(None).cast("string")
    for e, f in FORMATS.items():
        out = F.when(ext == e, F.lit(f)).otherwise(out)
    return out


def file_class(path: Column) -> Column:
    """archive, text, parse or unsupported."""
    ext = extension(path)
    return F.when(ext == ARCHIVE_EXTENSION, "archive").when(ext.isin(*TEXT_EXTENSIONS), "text").when(ext.isin(*FORMATS), "parse").otherwise("unsupported")


def format_error(path: Column) -> Column:
    """struct(code, message) where the format is not supported, else null."""
    message = F.concat(F.lit("Unsupported file extension: "), F.coalesce(F.nullif(extension(path), F.lit("")), F.lit("(none)")))
    return F.when(detect_format(path).isNull(), F.struct(F.lit(UNSUPPORTED).alias("code"), message.alias("message")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


#: The path of an archive's entry: archives end in .zip, and no entry that is given out begins with a slash. Other exclamation marks in a path mean nothing.
ENTRY = r"(?is)^(.*?\.zip)!(?!/)(.+)$"


def inner_name(path: Column) -> Column:
    """An entry's name in its archive; of any other file the path."""
    return F.when(path.rlike(ENTRY), F.regexp_extract(path, ENTRY, 2)).otherwise(path)


def archive_path(path: Column, entry: Column) -> Column:
    """The archive that an entry of this path and name is in."""
    return F.left(path, F.char_length(path) - F.char_length(entry) - 1)


def stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*\z", "")


def size_mb(n_bytes: Column) -> Column:
    return F.floor(n_bytes / 1048576 * 1000 + 0.5) / 1000


def fingerprint(config: dict) -> str:
    """Twelve digits for a configuration; the order of its keys counts, keys without a value do not."""
    given = {k: v for k, v in config.items() if v is not None}
    return hashlib.sha256(json.dumps(given, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:12]


def cache_key(file_hash: Column, config: str | Column, prompt_hash: Column | None = None) -> Column:
    parts = [file_hash, F.lit(config) if isinstance(config, str) else config]
    whole = F.concat_ws("|", *parts, *([] if prompt_hash is None else [prompt_hash]))
    return F.concat(F.left(F.sha2(whole, 256), F.lit(16)), F.lit("-"), F.left(file_hash, F.lit(12)))


def numbers(first: Column, last: Column) -> Column:
    """first to last; none if last is smaller."""
    return F.when(last < first, F.array().cast("array<int>")).otherwise(F.sequence(first.cast("int"), last.cast("int")))


def select_pages(pages: Column, most: int = MAX_PAGES, ratio: tuple[int, int] = PAGE_RATIO) -> Column:
    """All pages if they are few, else the first and the last ones at that ratio."""
    head = -(-most * ratio[0] // sum(ratio))
    tail = most - head
    return F.when(pages <= most, numbers(F.lit(1), pages)).otherwise(F.concat(numbers(F.lit(1), F.lit(head)), numbers(pages - tail + 1, pages)))


def page_count(n_chars: Column) -> Column:
    """As good as a document without pages can say."""
    return F.greatest(F.lit(1), F.ceil(n_chars / CHARS_PER_PAGE)).cast("int")


def column_number(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)


def column_letters(n: Column) -> Column:
    """1 -> A, up to three letters (18,278 columns, more than a sheet has)."""
    letter = lambda x: F.char((x + 65).cast("long"))
    low, rest = F.pmod(n - 1, F.lit(26)), F.floor((n - 1) / 26)
    middle, top = F.pmod(rest - 1, F.lit(26)), F.floor((rest - 1) / 26)
    return F.concat(F.when(top > 0, letter(top - 1)).otherwise(""), F.when(rest > 0, letter(middle)).otherwise(""), letter(low))


#: Fixed words of file names and the prompts that they ask for, in this order.
ROUTES = (("contract", ("合同", "contract")), ("account-certificate", ("账户", "证明", "请款")), ("payment-summary", ("汇总", "进度款")))
SHEET_ROUTE, OTHER_ROUTE = "payment-summary", "generic"


def prompt_route(name: Column) -> Column:
    """The prompt for a file by its name."""
    low, out = F.lower(name), F.when(extension(name).isin(".xls", ".xlsx"), F.lit(SHEET_ROUTE)).otherwise(F.lit(OTHER_ROUTE))
    for prompt, parts in reversed(ROUTES):
        has = F.contains(low, F.lit(parts[0]))
        for p in parts[1:]:
            has = has | F.contains(low, F.lit(p))
        out = F.when(has, F.lit(prompt)).otherwise(out)
    return out


def file_concurrency(files: Column, cap: int = FILE_CONCURRENCY) -> Column:
    return F.greatest(F.lit(1), F.least(F.when(files < 1, 1).otherwise(files), F.lit(cap)))
