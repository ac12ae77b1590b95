"""OCR words and tables as text: lines from positions, grids from cells, and which of them is shown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import vendor
from docweave.functions.numbers import let, mean_confidence
from docweave.functions.text import escape_markdown, group_lines, trim

#: A line takes words whose top is within this share of the mean height of its median top, at least MIN_STEP.
HEIGHT_SHARE, MIN_STEP = 0.65, 8.0
WIDTH_SHARE, MIN_GAP = 0.8, 24.0
#: Pages of up to so many words are laid out word by word, others by numpy; words that are Python values at once; lines that are held before they are given on.
SMALL_PAGE, WORDS, LINES = 48, 100_000, 50_000
WHITE = " \t\n\r\f\v\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_END, BLANK_RUN, ODD = re.compile(r"\r?\n"), re.compile(rf"[{WHITE}]+"), re.compile(rf"[|{WHITE}]")


def line_starts(tops: list[float], reach: float) -> list[int]:
    """Where the lines begin among words in order of their top. A word joins the line whose upper median top is within reach; as the order is by top, that median is the line's middle word."""
    starts, start = [], 0
    for i, top in enumerate(tops):
        if i == 0 or abs(top - tops[start + (i - start) // 2]) > reach:
            starts.append(start := i)
    return starts


def lines_of(words: list[tuple[float, float, float, float, str]]) -> list[list[tuple]]:
    """words (x, y, w, h, text) of a page as its lines, top to bottom, each from left to right. Words without a text or a full box are in none."""
    words = sorted((b for b in words if b[4] and None not in b), key=lambda b: (b[1], b[0]))
    if not words:
        return []
    reach = max(MIN_STEP, HEIGHT_SHARE * sum([b[3] if b[3] > 1 else 1.0 for b in words]) / len(words))
    starts = line_starts([b[1] for b in words], reach)
    return [sorted(words[a:z], key=itemgetter(0)) for a, z in zip(starts, [*starts[1:], len(words)], strict=True)]


def shown(line: list[tuple]) -> str:
    """A line's words from left to right, with a blank where the gap is wide."""
    wide = max(MIN_GAP, WIDTH_SHARE * sum([b[2] if b[2] > 1 else 1.0 for b in line]) / len(line))
    out, right = [], 0.0
    for x, _, w, _, text in line:
        text = LINE_END.sub(" ", text.strip(WHITE).replace("|", "\\|")).strip(WHITE)
        if text:
            if out and x - right > wide:
                out.append(" ")
            out.append(text)
            right = x + w
    return BLANK_RUN.sub(" ", "".join(out)).strip(WHITE)


def _plain_lines(x, y, w, h, words: list[str]) -> tuple[list[int], list[str]]:
    """The lines of a page without odd words: their sizes and texts. Numbers are numpy arrays."""
    import numpy as np

    order = np.lexsort((x, y))
    reach = max(MIN_STEP, HEIGHT_SHARE * float(np.maximum(h, 1.0).mean()))
    starts = np.array(line_starts(y[order].tolist(), reach))
    line = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
    order = order[np.lexsort((np.arange(len(order)), x[order], line))]
    wide = np.maximum(MIN_GAP, WIDTH_SHARE * np.add.reduceat(np.maximum(w[order], 1.0), starts) / np.diff(np.r_[starts, len(order)]))
    right = x[order] + w[order]
    gap = np.r_[False, x[order][1:] - right[:-1] > wide[line[1:]]]
    gap[starts] = False
    parts = [f" {words[k]}" if g else words[k] for k, g in zip(order.tolist(), gap.tolist(), strict=True)]
    ends = [*starts.tolist(), len(parts)]
    return [b - a for a, b in zip(ends, ends[1:])], ["".join(parts[a:b]) for a, b in zip(ends, ends[1:])]


def _laid_out(batch) -> Iterator[tuple[list[int], list[str]]]:
    """The sizes and texts of the lines of each page of an Arrow batch with the arrays x, y, w, h, text."""
    cut = batch.column("text").offsets.to_numpy()
    own_words, numbers = batch.column("text").values, {c: batch.column(c) for c in "xywh"}
    # Of arrays without missing numbers the values are taken as they lie; the k-th page's begin at its offset.
    whole = all(v.null_count == 0 and v.values.null_count == 0 and (v.offsets.to_numpy() == cut).all() for v in numbers.values())
    values = {c: v.values.to_numpy(zero_copy_only=False) for c, v in numbers.items()} if whole else {}
    start, words = int(cut[0]), []  # some pages' words as Python values, from the word start on
    for k in range(batch.num_rows):
        a, z = int(cut[k]), int(cut[k + 1])
        if z > start + len(words):
            # As many pages more as have WORDS words, one at least.
            start, end = a, max(z, int(cut[max(k + 1, int(cut.searchsorted(a + WORDS, "right")) - 1)]))
            words = own_words.slice(a, end - a).to_pylist()
        own = words[a - start : z - start]
        if whole and len(own) > SMALL_PAGE and None not in own and "" not in own and ODD.search("\x00".join(own)) is None:
            yield _plain_lines(*(values[c][a:z] for c in "xywh"), own)
        else:
            found = lines_of(list(zip(*(values[c][a:z].tolist() if whole else v[k].as_py() or [] for c, v in numbers.items()), own, strict=True)))
            yield [len(line) for line in found], [shown(line) for line in found]


def page_lines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys, and the arrays x, y, w, h, text of their words) as keys, line_no, n_words, line.

    Who joins a line depends on who has joined it, which no window frame can say; a fold over arrays in
    expressions copies its state at each word. So this is an Arrow-batched function, without a shuffle.
    """
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("line_no", T.IntegerType()), T.StructField("n_words", T.LongType()), T.StructField("line", T.StringType())])

    def run(batches):
        import pyarrow as pa

        def given(batch, at, no, n, text):
            rows = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keys), pa.array(no, pa.int32()), pa.array(n, pa.int64()), pa.array(text, pa.string())], schema.names)

        for batch in batches:
            at, no, n, text = [], [], [], []
            for k, (sizes, lines) in enumerate(_laid_out(batch)):
                at += [k] * len(sizes)
                no += range(1, len(sizes) + 1)
                n += sizes
                text += lines
                if len(at) >= LINES:
                    yield given(batch, at, no, n, text)
                    at, no, n, text = [], [], [], []
            if at:
                yield given(batch, at, no, n, text)

    return pages.select(*keys, "x", "y", "w", "h", "text").mapInArrow(run, schema)


def _parts(batch, most: int) -> Iterator[tuple[int, list[tuple[list[int], list[str]]]]]:
    """The pages of _laid_out some at a time, with the place of the first of them: as many as have most lines, or all that are left."""
    first, pages, held = 0, [], 0
    for page in _laid_out(batch):
        pages.append(page)
        held += len(page[0])
        if held >= most:
            yield first, pages
            first, pages, held = first + len(pages), [], 0
    if pages:
        yield first, pages


def with_lines(pages: DataFrame) -> DataFrame:
    """pages (anything, and the arrays x, y, w, h, text of their words) with lines, an array of each page's lines that are not empty, in place of the words: a row stays a row, so what else it has need not be joined again."""
    others = [c for c in pages.columns if c not in ("x", "y", "w", "h", "text")]
    schema = T.StructType([*(pages.schema[c] for c in others), T.StructField("lines", T.ArrayType(T.StringType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, part in _parts(batch, LINES):
                lines = pa.array([[line for line in lines if line] for _, lines in part], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(part)) for c in others), lines], schema.names)

    return pages.mapInArrow(run, schema)


def block_lines(found: Column) -> Column:
    """The words of blocks as x, y, w, h, text arrays in one struct, for page_lines; blocks without a box are left out."""

    def parts(placed: Column) -> Column:
        part = lambda k: F.transform(placed, lambda b: F.get(b["bbox"], F.lit(k)))
        return F.struct(part(0).alias("x"), part(1).alias("y"), part(2).alias("w"), part(3).alias("h"), F.transform(placed, lambda b: b["text"]).alias("text"))

    return let(F.filter(found, lambda b: b["bbox"].isNotNull()), parts)


def vendor_pages(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """Replies of the cloud OCR (a row each, told apart by keys) as keys, text, blocks, avg_confidence."""
    data = F.col("__data")
    read = replies.select(*keys, vendor.reply_data(F.col(reply)).alias("__data"))
    read = read.select(*keys, vendor.blocks(data).alias("blocks"), vendor.tables(data).alias("__tables"), vendor.structured(data).alias("__structured"), F.col("__data.content").alias("__content"))
    both = with_lines(read.select(*keys, "blocks", "__tables", "__structured", "__content", F.inline(F.array(block_lines(F.col("blocks"))))))
    text = extracted_text(F.col("__tables"), F.col("__structured"), group_lines(F.col("lines")), F.col("__content"), F.transform("blocks", lambda b: b["text"]))
    return both.select(*keys, text.alias("text"), "blocks", mean_confidence(F.transform("blocks", lambda b: b["confidence"])).alias("avg_confidence"))


def table_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, row_start, col_start, text; seq breaks ties) as keys, body: the table of each group, see vendor.grid_markdown. Cells are put together once; a table is part of a page."""
    at = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    whole = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", at("row_start").alias("r"), at("col_start").alias("c"), "text"))).alias("cells"))
    return whole.select(*keys, vendor.grid_markdown(F.col("cells")).alias("body")).where("body <> ''")


def extracted_text(tables: Column, structured: Column, positioned: Column, content: Column, plain: Column) -> Column:
    """What a page shows: tables and structured text, else the words by position, else the content's lines, else the words as they come."""
    sections = F.filter(F.concat(F.coalesce(tables, F.array().cast("array<string>")), F.array(F.coalesce(structured, F.lit("")))), lambda s: s != "")
    lines = F.filter(F.transform(F.split(trim(content), "\n+"), escape_markdown), lambda s: s != "")
    joined = lambda a, sep: F.nullif(F.array_join(a, sep), F.lit(""))
    return F.coalesce(F.nullif(trim(F.array_join(sections, "\n\n")), F.lit("")), F.nullif(positioned, F.lit("")), joined(lines, "\n"), joined(F.transform(plain, escape_markdown), "\n"), F.lit(""))
