"""Structured extraction: packing sources into batches, prompts, model calls, merging what they return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import user_prompt
from docweave.operators.packing import batch_numbers, numbered  # noqa: F401

MAX_INPUT_CHARS = 500_000
SEPARATOR = "\n\n---\n\n"
#: The question that is asked without a prompt; the keys are fixed.
DEFAULT_PROMPT = """Read the documents below and answer with one JSON object and nothing else. Its keys:
title (string), documentType (string), parties (list of strings), keyAmount (string or null), keyDate (string or null), summary (string, three sentences at most).
Use null where the documents say nothing. Do not guess."""


def pack_sources(sources: DataFrame, keys: list[str], most: int = MAX_INPUT_CHARS, **sizes_of_tasks) -> DataFrame:
    """sources (keys, seq, name, text) with batch_no; seq tells a job's sources apart. Only the sizes are put in order (operators.packing), the texts are joined with their batch afterwards."""
    sizes = sources.select(*keys, "seq", F.char_length("text").alias("__n"))
    return sources.join(numbered(sizes, keys, "seq", most, **sizes_of_tasks), [*keys, "seq"])


def batch_texts(packed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, batch_no, n_sources, text: the sources of each batch, one after the other."""
    both = F.array_sort(F.collect_list(F.struct("seq", "name", "text")))
    joined = F.transform(both, lambda s: F.concat(F.lit("# File: "), s["name"], F.lit("\n\n"), s["text"]))
    return packed.groupBy(*keys, "batch_no").agg(F.count("*").alias("n_sources"), F.array_join(joined, SEPARATOR).alias("text"))


def prompts(batches: DataFrame, body: str = DEFAULT_PROMPT) -> DataFrame:
    """Adds prompt and chars (of the whole prompt)."""
    return batches.withColumn("prompt", user_prompt(F.lit(body), F.col("text"))).withColumn("chars", F.char_length("prompt").cast("long"))


def merge_last_wins(fields: DataFrame, keys: list[str], batch: str = "batch_no", name: str = "k", value: str = "v") -> DataFrame:
    """keys, name, value, first_batch: of each name the value of its last batch. first_batch gives the order of first sight."""
    return fields.groupBy(*keys, name).agg(F.max_by(value, batch).alias(value), F.min(batch).alias("first_batch"))


def batch_stats(batches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, batches: what each answered batch took, in order."""
    one = F.struct("batch_no", F.col("n_sources").alias("sources"), "chars", F.col("ms").alias("llm_ms"), "prompt_tokens", "completion_tokens", "parse_failed")
    return batches.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("batches"))


def structure_totals(batches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_batches, n_sources, chars, ms, prompt_tokens, completion_tokens, any_failed of answered batches."""
    return batches.groupBy(*keys).agg(
        F.count("*").alias("n_batches"), F.sum("n_sources").alias("n_sources"), F.sum("chars").alias("chars"), F.sum("ms").alias("ms"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.bool_or("parse_failed").alias("any_failed"),
    )
