"""Queries on replies of OCR models: envelopes, the cloud vendor's JSON, its blocks, tables and texts; and on measures of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import files, numbers, text, vendor
from docweave.operators import layout, metrics
from docweave.plans.registry import query, table


@query("peel_envelope", "SELECT event_id, CASE event_id % 6 WHEN 3 THEN '{\"text\": 5}' WHEN 4 THEN '{\"text\": \"a' WHEN 5 THEN concat('x {\"text\":\"', event_type, '\"}') ELSE event_type END AS body FROM events")
def peel_envelope(spark, sf_dir):
    k, said = F.col("event_id") % 6, F.col("event_type")
    envelope = F.concat(F.lit('{"text":" '), said, F.lit(' ","n":1}'))
    reply = (
        F.when(k == 0, F.concat(F.lit("  "), said, F.lit("\n"))).when(k == 1, envelope).when(k == 2, F.concat(F.lit("```markdown\n"), envelope, F.lit("\n```\n")))
        .when(k == 3, F.lit('{"text": 5}')).when(k == 4, F.lit('{"text": "a')).otherwise(F.concat(F.lit('x {"text":"'), said, F.lit('"}')))
    )
    return table(spark, sf_dir, "events").select("event_id", text.peel_envelope(reply).alias("body"))


# A reply for each order, with a word for each line; the words' boxes and confidences come in all their spellings, and some words are empty.
def _words(spark, sf_dir):
    k = F.col("l_linenumber")
    x, y = (F.col("l_partkey") % 100).cast("double"), (k * 30).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    w, h = F.lit(40.0), F.lit(10.0)
    corners = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))
    pairs = F.transform(corners, lambda p: F.array(p["x"], p["y"]))
    word = F.when(k % 5 == 4, "").otherwise(F.concat(F.lit("w"), F.col("l_suppkey").cast("string"), F.lit("|"), "l_returnflag"))
    js = lambda c: F.to_json(F.struct(c.alias("v")))  # noqa: E731  a value as JSON text, once the brackets are off
    bare = lambda c: F.regexp_extract(js(c), r'(?s)^\{"v":(.*)\}$', 1)
    box = (
        F.when(k % 4 == 0, F.concat(F.lit('"position":'), F.to_json(F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")))))
        .when(k % 4 == 1, F.concat(F.lit('"pos":'), bare(corners))).when(k % 4 == 2, F.concat(F.lit('"points":'), bare(pairs))).otherwise(F.lit('"angle":0'))
    )
    sure = F.when(k % 3 == 0, F.concat(F.lit('"prob":'), (F.col("l_quantity") + 50).cast("string"))).when(k % 3 == 1, F.concat(F.lit('"confidence":'), (F.col("l_quantity") / 100).cast("string"))).otherwise(F.lit('"other":1'))
    name = F.when(k % 2 == 0, F.lit('"word":')).otherwise(F.lit('"text":'))
    one = F.concat(F.lit("{"), name, bare(word), F.lit(","), box, F.lit(","), sure, F.lit("}"))
    # One row a line of the order, the first by its keys. An order's rows come together once, before they are JSON.
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")))
    whole = lines.groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("json")))), lambda x: x["json"]), ","), F.lit("]")).alias("words"))
    data = F.concat(F.lit('{"prism_wordsInfo":'), F.col("words"), F.lit("}"))
    # The data comes as an object, or as JSON text; with a body around it, or without.
    key = F.col("l_orderkey")
    as_text = F.when(key % 2 == 0, data).otherwise(bare(data))
    reply = F.concat(F.when(key % 3 == 0, F.lit('{"data":')).otherwise(F.lit('{"Data":')), as_text, F.lit("}"))
    return whole.select("l_orderkey", F.when(key % 5 == 0, F.concat(F.lit('{"body":'), reply, F.lit("}"))).otherwise(reply).alias("reply"))


ORDER_LINES = "(SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query("ocr_blocks", f"""SELECT l_orderkey, concat('aliyun-', i) AS block_id, concat('w', s, '|', f) AS text, CASE WHEN k % 4 <> 3 THEN CAST(p % 100 AS DOUBLE) END AS x, CASE WHEN k % 4 <> 3 THEN CAST(k * 30 AS DOUBLE) END AS y,
  CASE WHEN k % 4 <> 3 THEN CAST(40 AS DOUBLE) END AS w, CASE WHEN k % 4 <> 3 THEN CAST(10 AS DOUBLE) END AS h, CASE k % 3 WHEN 0 THEN least(1::DOUBLE, (q + 50) / 100) WHEN 1 THEN least(1::DOUBLE, q / 100) END AS confidence FROM {ORDER_LINES} WHERE k % 5 <> 4""")
def ocr_blocks(spark, sf_dir):
    found = _words(spark, sf_dir).select("l_orderkey", F.inline(vendor.blocks(vendor.reply_data(F.col("reply")))))
    return found.select("l_orderkey", "block_id", "text", *(F.get("bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")), "confidence")


@query("ocr_vendor_pages", f"""SELECT l_orderkey, string_agg(concat('w', s, '\\|', f), chr(10) ORDER BY k) AS text, count(*) AS n_lines FROM (SELECT *, bool_or(k % 4 <> 3) OVER (PARTITION BY l_orderkey) AS placed FROM {ORDER_LINES} WHERE k % 5 <> 4) WHERE NOT placed OR k % 4 <> 3 GROUP BY l_orderkey""")
def ocr_vendor_pages(spark, sf_dir):
    """Words with boxes by their lines; where no word has one, all words as they come. Orders whose words are all empty have no text."""
    found = layout.vendor_pages(_words(spark, sf_dir), ["l_orderkey"]).where("text <> ''")
    return found.select("l_orderkey", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


# A reply for each customer, with its orders as a table in either spelling, and paragraphs, rows or content beside it.
def _tables(spark, sf_dir):
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("rows"))
    key = F.col("o_custkey")
    cell = lambda r, c, t, k: F.when(k == 0, F.struct(r.alias("rowStart"), r.alias("rowEnd"), c.alias("columnStart"), c.alias("columnEnd"), t.alias("cellContent"), F.lit(None).cast("int").alias("ysc"), F.lit(None).cast("int").alias("xsc"), F.lit(None).cast("string").alias("word"))).otherwise(
        F.struct(F.lit(None).cast("int").alias("rowStart"), F.lit(None).cast("int").alias("rowEnd"), F.lit(None).cast("int").alias("columnStart"), F.lit(None).cast("int").alias("columnEnd"), F.lit(None).cast("string").alias("cellContent"), r.alias("ysc"), c.alias("xsc"), t.alias("word")))
    lit = lambda n: F.lit(n).cast("int")
    kind = key % 2
    line = lambda o, i: F.array(cell((i + 1).cast("int"), lit(0), o["o_orderkey"].cast("string"), kind), cell((i + 1).cast("int"), lit(2), F.concat(o["o_orderstatus"], F.lit("|"), o["o_orderpriority"]), kind))
    cells = F.concat(F.array(cell(lit(0), lit(0), F.lit("Order"), kind), cell(lit(0), lit(1), F.lit(""), kind)), F.flatten(F.transform("rows", line)))
    grid = F.struct(F.when(kind == 0, cells).alias("cellDetails"), F.when(kind == 1, cells).alias("cellInfos"))
    part = F.struct(F.struct(F.array(grid).alias("tableDetails")).alias("tableInfo"), F.struct(F.array(F.struct(F.concat(F.lit("Customer "), key.cast("string"), F.lit(" | part")).alias("paragraphContent"))).alias("paragraphDetails")).alias("paragraphInfo"))
    own = F.struct(F.array(grid).alias("prism_tablesInfo"), F.array(F.struct(F.lit("row one").alias("word")), F.struct(F.lit(" ").alias("word")), F.struct(F.lit("row two").alias("word"))).alias("prism_rowsInfo"))
    reply = F.when(key % 3 == 0, F.to_json(F.struct(F.struct(F.array(part).alias("subImages")).alias("Data")))).when(key % 3 == 1, F.to_json(F.struct(own.alias("Data")))).otherwise(F.to_json(F.struct(F.lit(" one | line\n\n two ").alias("data"))))
    return top.select("o_custkey", reply.alias("reply"))


@query("ocr_vendor_tables", """SELECT o_custkey, CASE o_custkey % 3 WHEN 0 THEN concat(grid, E'\\n\\n', 'Customer ', o_custkey, ' \\| part') WHEN 1 THEN concat(grid, E'\\n\\nrow one\\nrow two') ELSE concat('one \\| line', chr(10), 'two') END AS text
  FROM (SELECT o_custkey, concat(E'| Order | Column 2 |\\n| --- | --- |\\n', string_agg(concat('| ', o_orderkey, ' | ', o_orderstatus, '\\|', o_orderpriority, ' |'), chr(10) ORDER BY o_orderkey)) AS grid FROM orders GROUP BY o_custkey)""")
def ocr_vendor_tables(spark, sf_dir):
    return layout.vendor_pages(_tables(spark, sf_dir), ["o_custkey"]).select("o_custkey", "text")


@query("block_ids", "SELECT s_suppkey, concat('p', s_nationkey + 1, '-', CASE k WHEN 1 THEN 'aliyun-1' ELSE 'b2' END) AS page_block, CASE k WHEN 1 THEN 'aliyun-1' ELSE 'b2' END AS image_block FROM (SELECT *, unnest([1, 2]) AS k FROM supplier)")
def block_ids(spark, sf_dir):
    one = lambda name: F.struct(F.lit(name).cast("string").alias("block_id"), F.col("s_name").alias("text"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("double").alias("confidence"))
    found = F.array(one("aliyun-1"), one(None))
    ids = F.arrays_zip(vendor.numbered_blocks(found, F.col("s_nationkey") + 1).alias("p"), vendor.numbered_blocks(found).alias("i"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(ids).alias("x")).select("s_suppkey", F.col("x.p.block_id").alias("page_block"), F.col("x.i.block_id").alias("image_block"))


@query("upper_median", "SELECT user_id, list_sort(list(v))[len(list(v)) // 2 + 1] AS upper_median FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY user_id")
def upper_median(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.floor("value")).alias("v"))
    return found.select("user_id", numbers.upper_median(F.col("v")).cast("long").alias("upper_median"))


@query("line_predicates", """SELECT doc_id, i AS line_no, length(t) <= 40 AND NOT regexp_matches(t, '[:：。；;,.，]$') AND regexp_matches(t, '(合同|协议|证明|申请表|验收表|汇总表|进度款|账户|发票|收据|报告|照片)$') AS heading, regexp_matches(t, '^[-•·]') AS item
  FROM (SELECT doc_id, i, CASE i % 3 WHEN 0 THEN concat(left(x, 44), '合同') WHEN 1 THEN concat('• ', x) ELSE x END AS t FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""")
def line_predicates(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x"))
    n = F.col("i") + 1
    line = F.when(n % 3 == 0, F.concat(F.left("x", F.lit(44)), F.lit("合同"))).when(n % 3 == 1, F.concat(F.lit("• "), "x")).otherwise(F.col("x"))
    return lines.select("doc_id", n.cast("long").alias("line_no"), text.is_heading(line).alias("heading"), text.is_list_item(line).alias("item"))


LINES_SQL = "(SELECT doc_id, i, t FROM (SELECT doc_id, i, trim(x, E' \\n\\t\\r') AS t FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT doc_id, list_concat(['2024合同', '• item one'], string_split(text, chr(10))) AS l FROM documents))) WHERE t <> '')"
GROUPED_SQL = f"""SELECT doc_id, trim(regexp_replace(string_agg(concat(CASE WHEN i > 1 AND NOT before_heading AND (heading OR (NOT item AND NOT regexp_matches(before_shown, '^(## |[-*] )') AND (regexp_matches(t, '^[一二三四五六七八九十]+[、.．]|^[0-9]+[、.．)]') OR regexp_matches(before_shown, '[。！？!?；;：:]$')))) THEN chr(10) ELSE '' END, shown, CASE WHEN heading THEN chr(10) ELSE '' END), chr(10) ORDER BY i), '\\n{{3,}}', E'\\n\\n', 'g'), E' \\n\\t\\r') AS md
  FROM (SELECT *, lag(heading, 1, false) OVER w AS before_heading, lag(shown, 1, '') OVER w AS before_shown FROM
    (SELECT *, CASE WHEN heading THEN concat('## ', regexp_replace(t, '^#+\\s*', '')) WHEN item THEN concat('- ', regexp_replace(t, '^[-•·]\\s*', '')) ELSE t END AS shown FROM
      (SELECT *, length(t) <= 40 AND NOT regexp_matches(t, '[:：。；;,.，]$') AND regexp_matches(t, '(合同|协议|证明|申请表|验收表|汇总表|进度款|账户|发票|收据|报告|照片)$') AS heading, regexp_matches(t, '^[-•·]') AS item FROM {LINES_SQL}))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id"""


@query("group_lines", GROUPED_SQL)
def group_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.group_lines(F.concat(F.array(F.lit("2024合同"), F.lit("• item one")), F.split("text", "\n", -1))).alias("md"))


# Calls: an event is a call that begins at its second of the day and lasts as many seconds as its value says.
@query("peak_in_flight", """SELECT event_type, CAST(max(n) AS BIGINT) AS peak FROM (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY at_ms) AS n FROM (SELECT event_type, at_ms, sum(d) AS d FROM
  (SELECT event_type, unnest([event_id * 1000, event_id * 1000 + greatest(1, CAST(floor(value * 1000) AS BIGINT))]) AS at_ms, unnest([1, -1]) AS d FROM events) GROUP BY event_type, at_ms)) GROUP BY event_type""")
def peak_in_flight(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") * 1000).alias("started_ms"), F.floor(F.col("value") * 1000).alias("ms"))
    return metrics.peak_in_flight(calls, ["event_type"]).select("event_type", F.col("peak").cast("long").alias("peak"))


@query("performance_metrics", """SELECT user_id, CAST(sum(ms) AS BIGINT) AS total_ms, CAST(sum(CASE WHEN s = 0 THEN ms ELSE 0 END) AS BIGINT) AS extract_ms, CAST(sum(CASE WHEN s = 1 THEN ms ELSE 0 END) AS BIGINT) AS ocr_ms, CAST(sum(CASE WHEN s = 2 THEN ms ELSE 0 END) AS BIGINT) AS seal_ms,
  CAST(sum(CASE WHEN s = 3 THEN ms ELSE 0 END) AS BIGINT) AS llm_ms, CAST(sum(r) AS BIGINT) AS retries, count(*) FILTER (s IN (1, 2)) AS images FROM (SELECT user_id, event_id % 4 AS s, CAST(floor(value) AS BIGINT) AS ms, event_id % 3 AS r FROM events) GROUP BY user_id""")
def performance_metrics(spark, sf_dir):
    stage = F.get(F.array(*map(F.lit, ("extract", "ocr", "seal", "llm"))), (F.col("event_id") % 4).cast("int"))
    calls = table(spark, sf_dir, "events").select("user_id", stage.alias("stage"), F.floor("value").alias("ms"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3).alias("retries"))
    return metrics.performance(calls, ["user_id"])


@query("perf_rollup", "SELECT event_type, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS ms, CAST(sum(event_id % 7) AS BIGINT) AS images, event_type IS NULL AS total FROM events GROUP BY ROLLUP (event_type)")
def perf_rollup(spark, sf_dir):
    perf = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("ms"), (F.col("event_id") % 7).alias("images"))
    return metrics.rolled_up(perf, "event_type", ["ms", "images"])


@query("field_counts", "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE len(json_keys(props)) END AS BIGINT) AS fields FROM events")
def field_counts(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 > 0, F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", metrics.field_count(said).alias("fields"))


@query("prompt_routes", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'contract' WHEN 1 THEN 'account-certificate' WHEN 2 THEN 'payment-summary' WHEN 3 THEN 'payment-summary' ELSE 'generic' END AS prompt FROM part")
def prompt_routes(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ("2024 Contract {}.pdf", "账户证明{}.pdf", "{}.XLSX", "进度款{}.pdf", "{}.png"))), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", files.prompt_route(F.replace(name, F.lit("{}"), F.col("p_partkey").cast("string"))).alias("prompt"))


@query("output_names", "SELECT p_partkey, concat('/out/', p_brand, CASE WHEN n > 1 THEN concat('.', n) ELSE '' END, '.md') AS out_file FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def output_names(spark, sf_dir):
    from docweave.plans.sinks import output_names as named

    slots = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("origin"), F.lit(0).alias("sub"), F.concat(F.lit("file:/in/"), "p_brand", F.lit(".pdf")).alias("path"))
    return named(slots, "/out/").select("p_partkey", "out_file")
