"""Documents to Markdown to costs by format, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import files, text
from docweave.functions.numbers import round_half_up
from docweave.plans.registry import documents

PRICE = 0.0008


def extract_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format (or text, or error), files, truncated, sections, md_bytes, yuan_e4 (of a mock call with a token a byte), first_hash.

    Every document has a row in some group: texts are taken as they are, archives and unknown kinds, which
    a table's text cannot be opened as, are errors without Markdown. Only DOC and DOCX are cut.
    """
    path = F.col("path")
    kind = F.coalesce(files.detect_format(path), F.when(files.file_class(path) == "text", "text"), F.lit("error"))
    docs = documents(spark, sf_dir).select(kind.alias("format"), "path", "text", F.sha2("text", 256).alias("file_hash"))
    whole = F.struct(F.col("text").alias("text"), F.lit(False).alias("truncated"))
    cut = text.truncate(F.col("text"))
    docs = docs.withColumn("cut", F.when(F.col("format").isin("doc", "docx"), F.struct(cut["text"].alias("text"), cut["truncated"].alias("truncated"))).otherwise(whole))
    parsed = ~F.col("format").isin("text", "error")
    docs = docs.withColumn("sections", F.when(parsed, text.paragraphs(F.regexp_replace("cut.text", "\n", "\n\n"))).otherwise(F.array().cast("array<string>")))
    body = F.array_join(F.transform("sections", text.trim), "\n\n")
    shown = F.concat(F.lit("# "), files.base_name(path), F.lit("\n\n"), body, F.lit("\n"))
    md = F.when(parsed, F.octet_length(shown)).when(F.col("format") == "text", F.octet_length("text")).otherwise(0)
    docs = docs.select("format", "file_hash", F.col("cut.truncated").alias("truncated"), F.size("sections").alias("n"), md.alias("md"))
    yuan = F.floor(F.col("md") / 1000 * PRICE * 10000 + 0.5)
    return docs.groupBy("format").agg(
        F.count("*").alias("files"), F.count_if("truncated").alias("truncated"), F.sum("n").alias("sections"), F.sum("md").alias("md_bytes"), F.sum(yuan).cast("long").alias("yuan_e4"), F.min("file_hash").alias("first_hash")
    )
