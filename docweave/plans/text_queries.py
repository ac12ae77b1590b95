"""Queries on text and layout: sheets, Markdown, marks, JSON, lines, tables, locators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import files, numbers, text
from docweave.functions.jsonfix import json_or_text, outermost_col
from docweave.operators import layout, markdown
from docweave.operators.locators import resolve_locators
from docweave.plans.registry import query, table

# A sheet for each nation's customers: A key, B name, C segment, and D balance in rows that have a positive one.
CUSTOMERS_SQL = "(SELECT c_nationkey AS sheet, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS r, * FROM customer)"
CELLS_SQL = f"""(SELECT sheet, r * 4 + k AS seq, concat(list_extract(['A', 'B', 'C', 'D'], k + 1), r) AS ref,
  CASE k WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN concat(c_name, '|') WHEN 2 THEN c_mktsegment ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS value, r, k
  FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM {CUSTOMERS_SQL}) WHERE k < 3 OR c_acctbal > 0)"""


def _cells(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    values = F.array(F.col("c_custkey").cast("string"), F.concat("c_name", F.lit("|")), F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("string")))
    cells = rows.select(F.col("c_nationkey").alias("sheet"), "r", F.posexplode(values).alias("k", "value")).where("value is not null and value <> ''")
    return cells.select("sheet", (F.col("r") * 4 + F.col("k")).alias("seq"), F.concat(files.column_letters(F.col("k") + 1), F.col("r").cast("string")).alias("ref"), "value", "r", "k")


@query("xlsx_cells", f"SELECT sheet, seq, ref, value FROM {CELLS_SQL}")
def xlsx_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("sheet", "seq", "ref", "value")


@query("a1_codec", "SELECT CAST(n AS INTEGER) AS n, concat(CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 AS INTEGER)) ELSE '' END, CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 27) // 26) % 26 AS INTEGER)) ELSE '' END, chr(CAST(65 + (n - 1) % 26 AS INTEGER))) AS letters, CAST(n AS INTEGER) AS again FROM (SELECT DISTINCT o_orderkey % 16384 + 1 AS n FROM orders)")
def a1_codec(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 16384 + 1).cast("int").alias("n")).distinct()
    letters = n.withColumn("letters", files.column_letters(F.col("n")))
    return letters.withColumn("again", files.column_number(F.col("letters")))


@query("sheet_density", f"SELECT sheet, count(*) AS n_cells, count(DISTINCT r) AS n_rows, count(*) / greatest(1, count(DISTINCT r)) >= 2 AND count(DISTINCT r) >= 2 AS as_table FROM {CELLS_SQL} GROUP BY sheet")
def sheet_density(spark, sf_dir):
    return markdown.sheet_density(_cells(spark, sf_dir), ["sheet"])


ROWS_SQL = f"""(SELECT sheet, r, concat('| ', coalesce(max(value) FILTER (k = 0), ''), ' | ', coalesce(replace(max(value) FILTER (k = 1), '|', '\\|'), ''), ' | ', coalesce(max(value) FILTER (k = 2), ''),
  CASE WHEN has_d THEN concat(' | ', coalesce(max(value) FILTER (k = 3), '')) ELSE '' END, ' |') AS line, has_d
  FROM (SELECT *, bool_or(k = 3) OVER (PARTITION BY sheet) AS has_d FROM {CELLS_SQL}) GROUP BY sheet, r, has_d)"""
TABLE_SQL = f"SELECT sheet, concat(CASE WHEN bool_or(has_d) THEN E'| A | B | C | D |\\n| --- | --- | --- | --- |\\n' ELSE E'| A | B | C |\\n| --- | --- | --- |\\n' END, string_agg(line, chr(10) ORDER BY r)) AS body FROM {ROWS_SQL} GROUP BY sheet"
LIST_SQL = f"SELECT sheet, string_agg(concat('- **', ref, '**: ', value), chr(10) ORDER BY seq) AS body FROM {CELLS_SQL} GROUP BY sheet"


@query("sheet_markdown_table", TABLE_SQL)
def sheet_markdown_table(spark, sf_dir):
    return markdown.sheet_tables(_cells(spark, sf_dir), ["sheet"])


@query("sheet_markdown_list", LIST_SQL)
def sheet_markdown_list(spark, sf_dir):
    return markdown.sheet_lists(_cells(spark, sf_dir), ["sheet"])


@query("sheet_markdown", f"SELECT t.sheet, CASE WHEN n_rows >= 2 AND n_cells / n_rows >= 2 THEN t.body ELSE l.body END AS body FROM ({TABLE_SQL}) t JOIN ({LIST_SQL}) l ON t.sheet = l.sheet JOIN (SELECT sheet, count(*) AS n_cells, count(DISTINCT r) AS n_rows FROM {CELLS_SQL} GROUP BY sheet) d ON t.sheet = d.sheet")
def sheet_markdown(spark, sf_dir):
    return markdown.sheets_markdown(_cells(spark, sf_dir), ["sheet"])


@query("to_markdown", """SELECT doc_id, concat('# doc_', doc_id, E'\\n\\n', CASE doc_id % 3
  WHEN 0 THEN (SELECT string_agg(concat('## Page ', i, E'\\n\\n', trim(x, E' \\n\\t\\r')), E'\\n\\n' ORDER BY i) FROM (SELECT unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x))
  WHEN 1 THEN (SELECT string_agg(trim(x, E' \\n\\t\\r'), E'\\n\\n' ORDER BY i) FROM (SELECT unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x)) ELSE text END, chr(10)) AS md
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def to_markdown(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    kind = F.col("doc_id") % 3
    pages = F.when(kind == 0, F.transform(lines, lambda x, i: F.struct((i + 1).alias("page_no"), x.alias("text"))))
    sections = F.when(kind == 1, F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("p-"), (i + 1).cast("string")).alias("section_id"), x.alias("text"))))
    sheets = F.lit(None).cast("array<struct<name:string,body:string>>")
    md = markdown.to_markdown(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), pages, sheets, sections, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", md.alias("md"))


@query("escape_cell", "SELECT doc_id, trim(replace(replace(text, '|', '\\|'), chr(10), ' '), E' \\t\\r') AS cell FROM documents")
def escape_cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_cell(F.col("text")).alias("cell"))


@query("escape_markdown", "SELECT doc_id, trim(regexp_replace(replace(text, '|', '\\|'), '\\r?\\n', ' ', 'g'), E' \\t\\r') AS escaped, regexp_replace(trim(regexp_replace(replace(text, '|', '\\|'), '\\r?\\n', ' ', 'g'), E' \\t\\r'), '\\s+', ' ', 'g') AS in_table FROM documents")
def escape_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_markdown(F.col("text")).alias("escaped"), text.escape_table_cell(F.col("text")).alias("in_table"))


# Marks: every supplier writes one seal and one signature into its text; the colour and shape go by its key.
def _marked(spark, sf_dir):
    pick = lambda n, *v: F.get(F.array(*map(F.lit, v)), (F.col("s_suppkey") % n).cast("int"))
    seal = F.concat(F.lit("【印章:"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("未知")).otherwise(F.col("s_name")), F.lit(" | "), pick(4, "红色", "蓝色", "黑色", "紫色"), F.lit(" | "), pick(4, "圆形", "椭圆形", "方形", "矩形"), F.lit("】"))
    sign = F.concat(F.lit("【签名: "), F.when(F.col("s_suppkey") % 3 == 0, F.lit("未知")).otherwise(F.concat(F.lit("signer "), F.col("s_nationkey").cast("string"))), F.lit("】"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("a "), seal, F.lit(" b "), sign, F.lit(" c "), seal).alias("text"))


@query("seal_marks", "SELECT s_suppkey, CAST(k AS INTEGER) AS seal_no, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS owner, CASE s_suppkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'black' END AS color, CASE s_suppkey % 4 WHEN 0 THEN 'circle' WHEN 1 THEN 'oval' ELSE 'rectangle' END AS shape FROM (SELECT *, unnest([1, 2]) AS k FROM supplier)")
def seal_marks(spark, sf_dir):
    return _marked(spark, sf_dir).select("s_suppkey", F.inline(text.seal_marks(F.col("text"))))


@query("signature_marks", "SELECT s_suppkey, 1 AS sig_no, CASE WHEN s_suppkey % 3 <> 0 THEN concat('signer ', s_nationkey) END AS signer FROM supplier")
def signature_marks(spark, sf_dir):
    return _marked(spark, sf_dir).select("s_suppkey", F.inline(text.signature_marks(F.col("text"))))


@query("seal_normalise", "SELECT s_suppkey, concat('seal-p', s_nationkey + 1, '-', k) AS seal_id, 'unknown' AS type, CAST(0.7 AS DOUBLE) AS confidence, 'pdf-bbox' AS locator_kind, s_nationkey + 1 AS page_no FROM (SELECT *, unnest([1, 2]) AS k FROM supplier)")
def seal_normalise(spark, sf_dir):
    from docweave.operators.marks import normalise_seals

    pages = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).alias("page_no"))
    found = _marked(spark, sf_dir).join(pages, "s_suppkey")
    return found.select("s_suppkey", F.inline(normalise_seals(text.seal_marks(F.col("text")), F.col("page_no")))).select("s_suppkey", "seal_id", "type", "confidence", "locator_kind", "page_no")


@query("signature_normalise", "SELECT s_suppkey, concat('sig-p', s_nationkey + 1, '-1') AS signature_id, 'handwritten' AS type, CAST(0.7 AS DOUBLE) AS confidence FROM supplier")
def signature_normalise(spark, sf_dir):
    from docweave.operators.marks import normalise_signatures

    pages = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1).alias("page_no"))
    found = _marked(spark, sf_dir).join(pages, "s_suppkey")
    return found.select("s_suppkey", F.inline(normalise_signatures(text.signature_marks(F.col("text")), F.col("page_no")))).select("s_suppkey", "signature_id", "type", "confidence")


@query("strip_fence", "SELECT event_id, props AS inner FROM events")
def strip_fence(spark, sf_dir):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\n```json\n"), F.col("props"), F.lit("\n```  \n"))).otherwise(F.concat(F.lit("  "), F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", text.strip_fence(fenced).alias("inner"))


def _mangled(spark, sf_dir):
    p, k = F.col("props"), F.col("event_id") % 7
    bare, single = F.replace(p, F.lit('"k"'), F.lit("k")), F.replace(p, F.lit('"'), F.lit("'"))
    reply = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("The answer: "), p, F.lit(" as asked.")))
        .when(k == 3, F.replace(p, F.lit("}"), F.lit(",}"))).when(k == 4, bare).when(k == 5, single).otherwise(F.lit("no object here"))
    )
    return table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))


@query("json_repair", "SELECT event_id, CASE WHEN event_id % 7 = 6 THEN '{\"text\":\"no object here\"}' ELSE replace(props, ' ', '') END AS extracted, event_id % 7 = 6 AS parse_failed FROM events")
def json_repair(spark, sf_dir):
    return _mangled(spark, sf_dir).select("event_id", json_or_text("reply").alias("x")).select("event_id", "x.extracted", "x.parse_failed")


@query("json_fallback", "SELECT event_id % 7 = 6 AS parse_failed, count(*) AS n FROM events GROUP BY 1")
def json_fallback(spark, sf_dir):
    return _mangled(spark, sf_dir).select(json_or_text("reply")["parse_failed"].alias("parse_failed")).groupBy("parse_failed").agg(F.count("*").alias("n"))


@query("json_slice", "SELECT event_id, CASE WHEN event_id % 7 = 3 THEN replace(props, '}', ',}') WHEN event_id % 7 = 4 THEN replace(props, '\"k\"', 'k') WHEN event_id % 7 = 5 THEN replace(props, '\"', '''') WHEN event_id % 7 = 6 THEN NULL ELSE props END AS sliced FROM events")
def json_slice(spark, sf_dir):
    return _mangled(spark, sf_dir).select("event_id", outermost_col(F.col("reply")).alias("sliced"))


@query("resolve_locator", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'sheet-cell' WHEN 1 THEN 'pdf-line' WHEN 2 THEN 'pdf-line' WHEN 3 THEN 'doc-anchor' END AS kind,
  CASE WHEN o_orderkey % 5 IN (1, 2) THEN CAST(o_orderkey % 50 AS INTEGER) END AS page_no, CASE WHEN o_orderkey % 5 = 2 THEN 4 END AS line_no,
  CASE o_orderkey % 5 WHEN 4 THEN 0.5 ELSE CASE WHEN (o_orderkey % 5 = 0 AND o_orderkey % 40 < 25) OR (o_orderkey % 5 IN (1, 2) AND o_orderkey % 50 BETWEEN 1 AND 30) OR (o_orderkey % 5 = 3 AND o_orderkey % 60 BETWEEN 1 AND 20) THEN 1.0 ELSE 0.5 END END::DOUBLE AS penalty FROM orders""")
def resolve_locator(spark, sf_dir):
    key = F.col("o_orderkey")
    s = lambda n: (key % n).cast("string")
    hint = (
        F.when(key % 5 == 0, F.concat(F.lit("S!A"), s(40))).when(key % 5 == 1, F.concat(F.lit("see 第 "), s(50), F.lit(" 页"))).when(key % 5 == 2, F.concat(F.lit("第"), s(50), F.lit("页第 4 行")))
        .when(key % 5 == 3, F.concat(F.lit("段落 p-"), s(60))).otherwise(F.lit("nowhere"))
    )
    cells = spark.range(25).select(F.lit("S").alias("sheet"), F.concat(F.lit("A"), F.col("id").cast("string")).alias("ref"))
    pages = spark.range(1, 31).select(F.col("id").cast("int").alias("page_no"))
    sections = spark.range(1, 21).select(F.concat(F.lit("p-"), F.col("id").cast("string")).alias("section_id"))
    found = resolve_locators(table(spark, sf_dir, "orders").select("o_orderkey", hint.alias("hint")), cells, pages, sections)
    return found.select("o_orderkey", "kind", "page_no", "line_no", "penalty")


# OCR words: each document's words on a grid of 8 a line, lines 20 apart, in boxes that tremble by up to 3 in height.
WORDS_SQL = """(SELECT doc_id, i, w, CAST((i % 8) * 100 AS DOUBLE) AS x, CAST((i // 8) * 20 + i % 4 AS DOUBLE) AS y FROM
  (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS w FROM (SELECT doc_id, list_filter(regexp_split_to_array(replace(text, '|', '/'), '\\s+'), lambda x: x <> '') AS l FROM documents)))"""


def _words(spark, sf_dir):
    split = F.filter(F.split(F.replace("text", F.lit("|"), F.lit("/")), r"\s+", -1), lambda w: w != "")
    words = table(spark, sf_dir, "documents").select("doc_id", split.alias("text"))
    of = lambda f: F.transform("text", lambda w, i: f(i).cast("double"))
    return words.withColumns({"x": of(lambda i: (i % 8) * 100), "y": of(lambda i: F.floor(i / 8) * 20 + i % 4), "w": of(lambda i: F.lit(50)), "h": of(lambda i: F.lit(12))})


@query("line_cluster", f"SELECT doc_id, CAST(i // 8 + 1 AS INTEGER) AS line_no, count(*) AS n_words FROM {WORDS_SQL} GROUP BY 1, 2")
def line_cluster(spark, sf_dir):
    return layout.page_lines(_words(spark, sf_dir), ["doc_id"]).select("doc_id", "line_no", "n_words")


@query("render_lines", f"SELECT doc_id, CAST(i // 8 + 1 AS INTEGER) AS line_no, string_agg(w, ' ' ORDER BY i) AS line FROM {WORDS_SQL} GROUP BY 1, 2")
def render_lines(spark, sf_dir):
    return layout.page_lines(_words(spark, sf_dir), ["doc_id"]).select("doc_id", "line_no", "line")


GRID_SQL = "(SELECT l_orderkey, l_linenumber AS r, k AS c, CASE k WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 2 THEN concat(l_returnflag, '|', l_linestatus) END AS text FROM (SELECT *, unnest([0, 2]) AS k FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)))"


@query("ocr_table_grid", f"SELECT l_orderkey, concat(max(head), string_agg(line, chr(10) ORDER BY r)) AS body FROM (SELECT l_orderkey, r, '' AS head, concat('| ', max(text) FILTER (c = 0), ' | ', replace(max(text) FILTER (c = 2), '|', '\\|'), ' |', CASE WHEN r = min(r) OVER (PARTITION BY l_orderkey) THEN E'\\n| --- | --- |' ELSE '' END) AS line FROM {GRID_SQL} GROUP BY l_orderkey, r) GROUP BY l_orderkey")
def ocr_table_grid(spark, sf_dir):
    put = F.array(F.col("l_partkey").cast("string"), F.lit(""), F.concat("l_returnflag", F.lit("|"), "l_linestatus"))
    # An order's rows come together once: both groupings that follow, and the table's own, find them there.
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_returnflag", "l_linestatus")))
    cells = lines.select("l_orderkey", F.col("l_linenumber").alias("row_start"), F.posexplode(put).alias("col_start", "text")).withColumn("seq", F.lit(0))
    return layout.table_markdown(cells, ["l_orderkey"])


@query("extract_text_precedence", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('| t |', E'\\n\\n', 'structured') WHEN 1 THEN 'positioned' WHEN 2 THEN 'a\\|b' || chr(10) || 'c' ELSE lang || chr(10) || source END AS shown FROM documents")
def extract_text_precedence(spark, sf_dir):
    k = F.col("doc_id") % 4
    shown = layout.extracted_text(
        F.when(k == 0, F.array(F.lit("| t |"))), F.when(k == 0, F.lit("structured")), F.when(k <= 1, F.lit("positioned")), F.when(k <= 2, F.lit(" a|b\n\nc ")), F.array("lang", "source")
    )
    return table(spark, sf_dir, "documents").select("doc_id", shown.alias("shown"))


@query("bbox_from_points", "SELECT l_orderkey, l_linenumber, CAST(least(l_partkey, l_suppkey) AS DOUBLE) AS x, CAST(least(l_linenumber, l_quantity) AS DOUBLE) AS y, CAST(greatest(l_partkey, l_suppkey) - least(l_partkey, l_suppkey) AS DOUBLE) AS w, CAST(greatest(l_linenumber, l_quantity) - least(l_linenumber, l_quantity) AS DOUBLE) AS h FROM lineitem")
def bbox_from_points(spark, sf_dir):
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    box = numbers.bbox(F.array(p("l_partkey", "l_quantity"), p("l_suppkey", "l_linenumber")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.get(box, F.lit(k)).alias(c) for k, c in enumerate("xywh")))


@query("confidence_norm", "SELECT event_id, CASE WHEN v > 1 THEN least(1.0, v / 100) ELSE greatest(0.0, v) END::DOUBLE AS confidence FROM (SELECT event_id, value - 5 AS v FROM events)")
def confidence_norm(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numbers.confidence(F.col("value") - 5).alias("confidence"))


@query("avg_confidence", "SELECT user_id, floor(CAST(sum(k) FILTER (k % 10 > 1) AS DOUBLE) / 128 / count(*) FILTER (k % 10 > 1) * 1000 + 0.5) / 1000 AS avg_confidence, count(*) AS n FROM (SELECT user_id, event_id % 100 AS k FROM events) GROUP BY user_id")
def avg_confidence(spark, sf_dir):
    k = F.collect_list(F.when(F.col("event_id") % 10 == 0, F.lit(float("inf"))).when(F.col("event_id") % 10 == 1, F.lit(float("nan"))).otherwise((F.col("event_id") % 100).cast("double") / 128))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(numbers.mean_confidence(k).alias("avg_confidence"), F.count("*").alias("n"))
