"""Hints of where a value comes from, resolved to cells, pages and sections that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed spellings of hints: a cell, a page with perhaps a line, a paragraph.
SHEET_CELL = r"^([^!]+)!([A-Z]+\d+(?::[A-Z]+\d+)?)\z"
PAGE_LINE = r"第\s*(\d+)\s*页(?:第\s*(\d+)\s*行)?"
ANCHOR = r"段落\s*(p-\d+|\w+)"
FOUND, NOT_FOUND = 1.0, 0.5


def resolve_locators(hints: DataFrame, cells: DataFrame, pages: DataFrame, sections: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """hints (keys, hint) with kind, sheet, ref, page_no, line_no, section_id and penalty.

    cells (keys, sheet, ref), pages (keys, page_no) and sections (keys, section_id) say what exists; keys
    tell documents apart. A row without a hint has no penalty. The existence tests are outer joins with
    distinct keys, so a hint never multiplies.
    """
    h = F.col("hint")
    cell, page, anchor = h.rlike(SHEET_CELL), h.rlike(PAGE_LINE), h.rlike(ANCHOR)
    kind = F.when(cell, "sheet-cell").when(page, "pdf-line").when(anchor, "doc-anchor")
    out = hints.withColumn("kind", kind)
    part = lambda k, pattern, group: F.when(F.col("kind") == k, F.nullif(F.regexp_extract(h, pattern, group), F.lit("")))
    out = out.withColumns({
        "sheet": part("sheet-cell", SHEET_CELL, 1), "ref": part("sheet-cell", SHEET_CELL, 2), "page_no": part("pdf-line", PAGE_LINE, 1).cast("int"),
        "line_no": part("pdf-line", PAGE_LINE, 2).cast("int"), "section_id": part("doc-anchor", ANCHOR, 1),
    })
    for name, there, on in (("in_cells", cells, ("sheet", "ref")), ("in_pages", pages, ("page_no",)), ("in_sections", sections, ("section_id",))):
        out = out.join(there.select(*keys, *on).distinct().withColumn(name, F.lit(True)), [*keys, *on], "left")
    there = F.coalesce("in_cells", "in_pages", "in_sections", F.lit(False))
    penalty = F.when(h.isNull() | (h == "") | there, FOUND).otherwise(NOT_FOUND)
    return out.withColumn("penalty", penalty).drop("in_cells", "in_pages", "in_sections")
