"""Replies of the cloud OCR as text and blocks: everything is expressions over the reply's JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import numbers
from docweave.functions.numbers import let
from docweave.functions.text import escape_markdown, escape_table_cell, trim

# Fixed names of the vendor's JSON. A word's box comes in several shapes, so it is read as text first.
CELL = "struct<rowStart:int,rowEnd:int,columnStart:int,columnEnd:int,ysc:int,yec:int,xsc:int,xec:int,cellContent:string,word:string>"
TABLE = f"struct<rowCount:int,columnCount:int,cellDetails:array<{CELL}>,cellInfos:array<{CELL}>>"
WORD = "struct<word:string,text:string,position:string,pos:string,points:string,prob:double,probability:double,confidence:double>"
LINE = "struct<word:string,text:string>"
SUB_IMAGE = f"struct<tableInfo:struct<tableDetails:array<{TABLE}>>,paragraphInfo:struct<paragraphDetails:array<struct<paragraphContent:string>>>,rowInfo:struct<rowDetails:array<struct<rowContent:string>>>>"
REPLY = f"struct<content:string,prism_wordsInfo:array<{WORD}>,prism_tablesInfo:array<{TABLE}>,prism_paragraphsInfo:array<{LINE}>,prism_rowsInfo:array<{LINE}>,subImages:array<{SUB_IMAGE}>>"
BLOCK_PREFIX = "aliyun-"
BLOCKS = "array<struct<block_id:string,text:string,bbox:array<double>,confidence:double>>"


def or_none(a: Column, kind: str) -> Column:
    return F.coalesce(a, F.array().cast(f"array<{kind}>"))


def reply_data(reply: Column) -> Column:
    """The data of a reply (REPLY): what its body holds under Data or data, as an object or as JSON text; other text becomes its content."""
    body = F.coalesce(F.get_json_object(reply, "$.body"), reply)
    data = let(body, lambda b: F.coalesce(F.get_json_object(b, "$.Data"), F.get_json_object(b, "$.data")))
    in_braces = lambda s: F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}"))

    def read(raw: Column) -> Column:
        is_object = (in_braces(raw) | let(trim(raw), in_braces)) & F.try_parse_json(raw).isNotNull()
        as_content = F.to_json(F.struct(raw.alias("content")))
        return F.from_json(F.when(is_object, raw).when(raw.isNotNull(), as_content).otherwise(F.lit("{}")), REPLY)

    return let(data, read)


def box_of(word: Column) -> Column:
    """[x, y, width, height] of a word: from a rectangle, from points {x, y} or from points [x, y]; null if none can be used."""

    def rectangle(flat: Column) -> Column:
        return let(F.array(flat["x"], flat["y"], flat["width"], flat["height"]), lambda whole: F.when(~F.exists(whole, lambda v: v.isNull()), whole))

    def read(raw: Column) -> Column:
        pairs = F.transform(F.from_json(raw, "array<array<double>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
        points = F.when(raw.rlike(r"^\s*\[\s*\["), pairs).otherwise(F.from_json(raw, "array<struct<x:double,y:double>>"))
        return F.when(raw.rlike(r"^\s*\{"), let(F.from_json(raw, "struct<x:double,y:double,width:double,height:double>"), rectangle)).otherwise(numbers.bbox(points))

    return let(F.coalesce(word["position"], word["pos"], word["points"]), read)


def blocks(data: Column) -> Column:
    """The words that have a text, numbered as they came: BLOCKS."""
    made = F.transform(
        or_none(data["prism_wordsInfo"], WORD),
        lambda w, i: F.struct(
            F.concat(F.lit(BLOCK_PREFIX), (i + 1).cast("string")).alias("block_id"), F.coalesce(w["word"], w["text"], F.lit("")).alias("text"),
            box_of(w).alias("bbox"), numbers.confidence(F.coalesce(w["prob"], w["probability"], w["confidence"])).alias("confidence"),
        ),
    )
    return F.filter(made, lambda b: b["text"] != "")


def cells_of(table: Column) -> Column:
    """A table's cells in either spelling: array<struct(r, c, text)>."""
    at = lambda x, a, b: F.greatest(F.lit(0), F.coalesce(x[a], x[b], F.lit(0)))
    return F.transform(
        or_none(F.coalesce(table["cellDetails"], table["cellInfos"]), CELL),
        lambda x: F.struct(at(x, "rowStart", "ysc").alias("r"), at(x, "columnStart", "xsc").alias("c"), F.coalesce(x["cellContent"], x["word"], F.lit("")).alias("text")),
    )


def grid_markdown(cells: Column) -> Column:
    """cells (array<struct(r, c, text)>, the last one at a place counts) as a Markdown table of the rows and columns that hold something; the first row is the head. Spans stay blank, as only a cell's first place gets its text. Empty if no cell has text."""
    line = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    ranked = F.array_sort(F.transform(cells, lambda x, i: F.struct(x["r"].alias("r"), x["c"].alias("c"), i.alias("i"), escape_table_cell(F.coalesce(x["text"], F.lit(""))).alias("text"))))

    def final(s: Column) -> Column:
        return F.filter(s, lambda x, i: (x["text"] != "") & (F.get(s, i + 1).isNull() | (F.get(s, i + 1)["r"] != x["r"]) | (F.get(s, i + 1)["c"] != x["c"])))

    # Cells are in order of row and column, so a row is a slice between two beginnings, and all is read once.
    def table(put: Column) -> Column:
        cols = F.array_sort(F.array_distinct(F.transform(put, lambda x: x["c"])))
        begins = F.filter(F.transform(put, lambda x, i: F.when((i == 0) | (F.get(put, i - 1)["r"] != x["r"]), i)), lambda i: i.isNotNull())

        def shown(both: Column) -> Column:
            cs, starts = both["cs"], both["starts"]

            def row(start: Column, i: Column) -> Column:
                blank = lambda k: F.when(i == 0, F.concat(F.lit("Column "), (k + 1).cast("string"))).otherwise("")
                own = F.slice(put, start + 1, F.coalesce(F.get(starts, i + 1), F.size(put)) - start)
                placed = F.struct(own.alias("own"), F.transform(own, lambda x: x["c"]).alias("at"))
                texts = let(placed, lambda o: F.transform(cs, lambda c, k: F.coalesce(F.get(o["own"], F.array_position(o["at"], c).cast("int") - 1)["text"], blank(k))))
                return let(texts, lambda t: F.when(i == 0, F.concat(line(t), F.lit("\n"), line(F.transform(cs, lambda c: F.lit("---"))))).otherwise(line(t)))

            return F.array_join(F.transform(starts, row), "\n")

        return F.when(F.size(put) > 0, let(F.struct(cols.alias("cs"), begins.alias("starts")), shown)).otherwise("")

    return let(let(ranked, final), table)


def tables(data: Column) -> Column:
    """The reply's tables that have cells, those of its parts last, as Markdown."""
    parts = F.flatten(F.transform(or_none(data["subImages"], SUB_IMAGE), lambda s: or_none(s["tableInfo"]["tableDetails"], TABLE)))
    all_ = F.concat(or_none(data["prism_tablesInfo"], TABLE), parts)
    return F.transform(F.filter(F.transform(all_, cells_of), lambda c: F.size(c) > 0), grid_markdown)


def structured(data: Column) -> Column:
    """The reply's paragraphs, or else its rows, that are not blank; empty without any."""
    own = lambda lines: F.transform(or_none(lines, LINE), lambda p: F.coalesce(p["word"], p["text"], F.lit("")))

    def parts(info: str, details: str, field: str, kind: str) -> Column:
        found = F.flatten(F.transform(or_none(data["subImages"], SUB_IMAGE), lambda s: or_none(s[info][details], kind)))
        return F.transform(found, lambda p: F.coalesce(p[field], F.lit("")))

    kept = lambda a: F.transform(F.filter(a, lambda t: trim(t) != ""), escape_markdown)
    paragraphs = kept(F.concat(own(data["prism_paragraphsInfo"]), parts("paragraphInfo", "paragraphDetails", "paragraphContent", "struct<paragraphContent:string>")))
    rows = kept(F.concat(own(data["prism_rowsInfo"]), parts("rowInfo", "rowDetails", "rowContent", "struct<rowContent:string>")))
    return F.when(F.size(paragraphs) > 0, F.array_join(paragraphs, "\n\n")).otherwise(F.array_join(rows, "\n"))


def numbered_blocks(found: Column, page_no: Column | None = None) -> Column:
    """blocks with ids that tell the page (of a PDF), or as they are (of an image); a block without an id gets its place."""
    page = F.lit("") if page_no is None else F.concat(F.lit("p"), page_no.cast("string"), F.lit("-"))
    own = lambda b, i: F.coalesce(F.nullif(b["block_id"], F.lit("")), F.concat(F.lit("b"), (i + 1).cast("string")))
    return F.transform(found, lambda b, i: F.struct(F.concat(page, own(b, i)).alias("block_id"), b["text"].alias("text"), b["bbox"].alias("bbox"), b["confidence"].alias("confidence")))
