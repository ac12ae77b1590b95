"""Queries on costs, batches, merging, and the two pipelines with mock backends; streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import numbers
from docweave.functions.text import user_prompt
from docweave.operators import structure
from docweave.operators.external import backoff_bounds
from docweave.operators.metrics import calls_by_model, total_cost
from docweave.plans.registry import DOCS_SQL, query, table

# Calls: an event's type says the model; tokens come from its value.
MODELS = ("qwen-plus", "qwen-turbo", "gpt-4o", "qwen-vl-max", "unknown-model")


def _models(spark, sf_dir):
    """event_type, model: types in order get the models in turn; the fifth one has no price."""
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    return types.select("event_type", F.get(F.array(*map(F.lit, MODELS)), F.row_number().over(Window.orderBy("event_type")) - 1).alias("model"))


MODEL_SQL = "(SELECT event_type, list_extract(['qwen-plus', 'qwen-turbo', 'gpt-4o', 'qwen-vl-max', 'unknown-model'], CAST(row_number() OVER (ORDER BY event_type) AS INTEGER)) AS model FROM (SELECT DISTINCT event_type FROM events))"
PRICES_SQL = "(VALUES " + ", ".join(f"('{m}', '{c}', CAST({p} AS DOUBLE), CAST({q} AS DOUBLE), CAST({i} AS DOUBLE))" for m, c, p, q, i in numbers.PRICES) + ") AS prices(model, currency, prompt_price, completion_price, image_price)"
CALLS_SQL = f"""(SELECT event_id, m.model, p, c, i, coalesce(floor((CASE WHEN currency = 'USD' THEN (CAST(p AS DOUBLE) / 1000 * prompt_price + CAST(c AS DOUBLE) / 1000 * completion_price + CAST(i AS DOUBLE) / 1000 * image_price) * CAST(7.2 AS DOUBLE)
  ELSE CAST(p AS DOUBLE) / 1000 * prompt_price + CAST(c AS DOUBLE) / 1000 * completion_price + CAST(i AS DOUBLE) / 1000 * image_price END) * 10000 + 0.5) / 10000, CAST(0 AS DOUBLE)) AS yuan
  FROM (SELECT event_id, event_type, CAST(floor(value * 10) AS BIGINT) AS p, CAST(floor(value) AS BIGINT) AS c, event_id % 50 AS i FROM events) e JOIN {MODEL_SQL} m ON e.event_type = m.event_type LEFT JOIN {PRICES_SQL} ON m.model = prices.model)"""


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "events").join(_models(spark, sf_dir), "event_type").select("event_id", "model", F.floor(F.col("value") * 10).alias("prompt_tokens"), F.floor("value").alias("completion_tokens"), (F.col("event_id") % 50).alias("image_tokens"), (F.col("event_id") % 3).alias("retries"))


@query("compute_cost", f"SELECT event_id, model, yuan FROM {CALLS_SQL}")
def compute_cost(spark, sf_dir):
    calls = _calls(spark, sf_dir).join(F.broadcast(numbers.price_table(spark)), "model", "left")
    return calls.select("event_id", "model", numbers.yuan(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("image_tokens")).alias("yuan"))


@query("calls_by_model", f"SELECT model, count(*) AS calls, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(i)::BIGINT AS image_tokens, sum(event_id % 3)::BIGINT AS retries, CAST(round(sum(yuan * 10000)) AS BIGINT) AS yuan_e4 FROM {CALLS_SQL} GROUP BY model")
def by_model(spark, sf_dir):
    return calls_by_model(_calls(spark, sf_dir)).select("model", "calls", "prompt_tokens", "completion_tokens", "image_tokens", "retries", F.round(F.col("yuan") * 10000).cast("long").alias("yuan_e4"))


@query("total_yuan", f"SELECT floor(sum(yuan) * 10000 + 0.5) / 10000 AS total_yuan, count(*) AS calls FROM {CALLS_SQL}")
def total_yuan(spark, sf_dir):
    return total_cost(_calls(spark, sf_dir))


# Sources: the documents of each source, packed by 20,000 characters. The recursion finds each batch's first document from the last one's.
PACKED_SQL = """(WITH RECURSIVE s AS (SELECT source, doc_id, text, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
  w AS (SELECT source, i, n AS used, 1 AS batch_no FROM s WHERE i = 1 UNION ALL
    SELECT s.source, s.i, CASE WHEN w.used + s.n > 20000 THEN s.n ELSE w.used + s.n END, CASE WHEN w.used + s.n > 20000 THEN w.batch_no + 1 ELSE w.batch_no END FROM w JOIN s ON s.source = w.source AND s.i = w.i + 1)
  SELECT s.source, s.doc_id, s.text, s.n, CAST(w.batch_no AS INTEGER) AS batch_no FROM s JOIN w ON s.source = w.source AND s.i = w.i)"""


def _packed(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("seq"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), "text")
    return structure.pack_sources(sources, ["source"], 20_000)


@query("pack_batches", f"SELECT source, doc_id, batch_no FROM {PACKED_SQL}")
def pack_batches(spark, sf_dir):
    return _packed(spark, sf_dir).select("source", F.col("seq").alias("doc_id"), "batch_no")


@query("pack_one_job", f"SELECT doc_id, batch_no FROM {PACKED_SQL.replace('PARTITION BY source ORDER', 'ORDER').replace('SELECT source, doc_id, text', 'SELECT 0 AS source, doc_id, text')}")
def pack_one_job(spark, sf_dir):
    """All documents as one job, whose ranges are packed side by side."""
    sources = table(spark, sf_dir, "documents").select(F.lit(0).alias("job"), F.col("doc_id").alias("seq"), F.lit("").alias("name"), "text")
    return structure.pack_sources(sources, ["job"], 20_000, in_task=0).select(F.col("seq").alias("doc_id"), "batch_no")


TEXTS_SQL = f"(SELECT source, batch_no, count(*) AS n_sources, string_agg(concat('# File: doc_', doc_id, E'\\n\\n', text), E'\\n\\n---\\n\\n' ORDER BY doc_id) AS text FROM {PACKED_SQL} GROUP BY source, batch_no)"


@query("join_sources", f"SELECT * FROM {TEXTS_SQL}")
def join_sources(spark, sf_dir):
    return structure.batch_texts(_packed(spark, sf_dir), ["source"])


@query("user_prompt", "SELECT doc_id, concat('Say what it is.', E'\\n\\n【文档原文】\\n', text) AS prompt FROM documents")
def prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", user_prompt(F.lit("Say what it is."), F.col("text")).alias("prompt"))


@query("structure_stats", f"SELECT source, batch_no, n_sources, length(concat('Ask.', E'\\n\\n【文档原文】\\n', text)) AS chars FROM {TEXTS_SQL}")
def structure_stats(spark, sf_dir):
    return structure.prompts(structure.batch_texts(_packed(spark, sf_dir), ["source"]), "Ask.").select("source", "batch_no", "n_sources", "chars")


@query("merge_last_wins", "SELECT conv_id, role AS k, arg_max(text, turn) AS v, min(turn) AS first_batch FROM conversations GROUP BY conv_id, role")
def merge_last_wins(spark, sf_dir):
    fields = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("batch_no"), F.col("role").alias("k"), F.col("text").alias("v"))
    return structure.merge_last_wins(fields, ["conv_id"])


@query("backoff_bounds", "SELECT event_id, CAST(least(15000, 500 * power(2, event_id % 8)) AS BIGINT) AS most_ms FROM events")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", backoff_bounds(F.col("event_id") % 8).alias("most_ms"))


@query("structure_end_to_end", f"SELECT source, count(*) AS n_batches, sum(n_sources)::BIGINT AS n_sources, sum(length(text) + 9 + {len(structure.DEFAULT_PROMPT)})::BIGINT AS chars, 'mock' AS mock_field, false AS any_failed FROM {TEXTS_SQL} GROUP BY source")
def structure_end_to_end(spark, sf_dir):
    from docweave.operators.external import MockLlm, call_llm

    asked = structure.prompts(structure.batch_texts(_packed(spark, sf_dir), ["source"]))
    answered = call_llm(asked, MockLlm(), ["source", "batch_no", "n_sources", "chars"]).withColumn("mock_field", F.get_json_object("extracted", "$.mockField"))
    totals = structure.structure_totals(answered, ["source"])
    merged = structure.merge_last_wins(answered.select("source", "batch_no", F.lit("mockField").alias("k"), F.col("mock_field").alias("v")), ["source"])
    return totals.join(merged, "source").select("source", "n_batches", "n_sources", "chars", F.col("v").alias("mock_field"), "any_failed")


FORMATS_SQL = "(SELECT doc_id, text, path, list_extract(['pdf', 'jpg', 'png', 'xlsx', 'xls', 'doc', 'docx', 'text', 'error', 'error'], CAST(doc_id % 10 + 1 AS INTEGER)) AS format FROM " + DOCS_SQL + ")"


@query("extract_end_to_end", f"""SELECT format, count(*) AS files, sum(CASE WHEN cut THEN 1 ELSE 0 END)::BIGINT AS truncated, sum(n)::BIGINT AS sections,
  sum(md)::BIGINT AS md_bytes, CAST(sum(floor(CAST(md AS DOUBLE) / 1000 * CAST(0.0008 AS DOUBLE) * 10000 + 0.5)) AS BIGINT) AS yuan_e4, min(file_hash) AS first_hash
  FROM (SELECT format, cut, sha256(text) AS file_hash, CASE WHEN format IN ('text', 'error') THEN 0 ELSE (SELECT count(*) FROM (SELECT unnest(l) AS x) WHERE trim(x) <> '') END AS n,
    CASE format WHEN 'error' THEN 0 WHEN 'text' THEN strlen(text) ELSE strlen(concat('# ', substr(path, 5), E'\n\n', (SELECT string_agg(trim(x, E' \t\r'), E'\n\n' ORDER BY i) FROM (SELECT unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i) WHERE trim(x) <> ''), chr(10))) END AS md
    FROM (SELECT *, string_split(CASE WHEN cut THEN concat(left(text, 3500), E'\n\n[... truncated ', length(text) - 5000, E' chars ...]\n\n', right(text, 1500)) ELSE text END, chr(10)) AS l FROM (SELECT *, format IN ('doc', 'docx') AND length(text) > 5000 AS cut FROM {FORMATS_SQL}))) GROUP BY format""")
def extract_end_to_end(spark, sf_dir):
    from docweave.plans.flagship import extract_costs

    return extract_costs(spark, sf_dir)


@query("stream_ingest_dedupe", "SELECT sha256(text) AS file_hash, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def stream_ingest_dedupe(spark, sf_dir):
    from docweave.streaming.ingest import ingest_once

    return ingest_once(spark, f"{sf_dir}/documents.parquet")


@query("events_tumbling", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts) - INTERVAL 10 MINUTE) FROM events) GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    from docweave.streaming.windows import daily_counts

    return daily_counts(spark, f"{sf_dir}/events.parquet")
