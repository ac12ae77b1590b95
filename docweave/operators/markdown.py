"""Documents as Markdown: ordered string aggregation and the pivot of a sheet's cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.files import column_number
from docweave.functions.text import escape_cell, trim

CELL = r"^([A-Z]+)(\d+)\z"
#: What stands for a sheet without cells.
EMPTY_SHEET = "_(empty)_"


def in_order(order: str, text: str) -> Column:
    """An aggregate: the texts of a group by their order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])


def join_in_order(order: str, text: str, separator: str) -> Column:
    return F.array_join(in_order(order, text), separator)


def cell_places(cells: DataFrame) -> DataFrame:
    """Adds row_no, col and col_no to cells that have a ref; null for a ref that is no cell."""
    is_cell = F.col("ref").rlike(CELL)
    col = F.when(is_cell, F.regexp_extract("ref", CELL, 1))
    return cells.withColumns({"row_no": F.when(is_cell, F.regexp_extract("ref", CELL, 2).cast("int")), "col": col, "col_no": column_number(col)})


def sheet_density(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_cells, n_rows, as_table: a sheet is a table from two rows and two cells a row on. Cells with odd refs count as cells."""
    n = cell_places(cells).groupBy(*keys).agg(F.count("*").alias("n_cells"), F.count_distinct("row_no").alias("n_rows"))
    return n.withColumn("as_table", (F.col("n_cells") / F.greatest(F.lit(1), F.col("n_rows")) >= 2) & (F.col("n_rows") >= 2))


def sheet_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, body: each sheet as a table. cells have ref, seq and value (text). Of cells with the same ref the last one counts.

    Rows are put together before sheets, so that a large sheet is dealt by rows.
    """
    placed = cell_places(cells).where("row_no is not null")
    last = placed.groupBy(*keys, "row_no", "col_no", "col").agg(F.max_by("value", "seq").alias("value"))
    rows = last.groupBy(*keys, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", escape_cell(F.coalesce("value", F.lit("")))))).alias("cells"))
    columns = last.select(*keys, "col_no", "col").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col_no", "col"))).alias("columns"))
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    filled = rows.join(columns, keys).withColumn("line", line(F.transform("columns", lambda c: F.coalesce(F.element_at("cells", c["col_no"]), F.lit("")))))
    head = F.concat_ws("\n", line(F.transform(F.first("columns"), lambda c: c["col"])), line(F.transform(F.first("columns"), lambda c: F.lit("---"))))
    return filled.groupBy(*keys).agg(F.concat_ws("\n", head, join_in_order("row_no", "line", "\n")).alias("body"))


def sheet_lists(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, body: each sheet as a list of its cells, in the order of seq."""
    line = F.concat(F.lit("- **"), F.col("ref"), F.lit("**: "), F.replace(F.coalesce("value", F.lit("")), F.lit("\n"), F.lit(" ")))
    return cells.withColumn("line", line).groupBy(*keys).agg(join_in_order("seq", "line", "\n").alias("body"))


def sheets_markdown(cells: DataFrame, keys: list[str], sheets: DataFrame | None = None) -> DataFrame:
    """keys, body: table or list, as the density says. Of sheets (keys), if given, those without cells are shown as empty."""
    judged = cells.join(sheet_density(cells, keys), keys)
    bodies = sheet_tables(judged.where("as_table"), keys).unionByName(sheet_lists(judged.where("not as_table"), keys))
    return bodies if sheets is None else sheets.select(*keys).join(bodies, keys, "left").withColumn("body", F.coalesce("body", F.lit(EMPTY_SHEET)))


def to_markdown(title: Column, pages: Column, sheets: Column, sections: Column, full_text: Column) -> Column:
    """A document's Markdown. pages: array<struct(page_no, text)>; sheets: array<struct(name, body)>; sections: array<struct(section_id, text)>; the first of them that has something is shown."""
    parts = lambda a, f: F.array_join(F.transform(a, f), "\n\n")
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    body = (
        F.when(some(pages), parts(pages, lambda p: F.concat(F.lit("## Page "), p["page_no"].cast("string"), F.lit("\n\n"), trim(F.coalesce(p["text"], F.lit(""))))))
        .when(some(sheets), parts(sheets, lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n\n"), s["body"])))
        .when(some(sections), parts(sections, lambda s: trim(F.coalesce(s["text"], F.lit("")))))
        .otherwise(F.coalesce(full_text, F.lit("")))
    )
    return F.concat(F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(""), body, F.lit("\n"))
