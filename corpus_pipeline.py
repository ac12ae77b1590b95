"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage works on all that the one before kept and gives the columns of documents (the last one gives
the packed pieces). A document is a row: rows without an id and rows that share a doc_id are judged each by its own text.
Other columns of documents stay as they are, whatever their names (but those that start with __ are for the stages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.best_fit_packing import best_fit_packing
from docweave.llm.common import discard, stored, table, written
from docweave.llm.decontamination import phrase_matches
from docweave.llm.line_dedup import line_dedup
from docweave.llm.quality_rules import quality_rules
from docweave.llm.simhash import representatives


def _packed(docs: DataFrame, *apart: str) -> DataFrame:
    """docs as the columns that a stage works on, and one with all but the text; so no other column meets those that an operator adds."""
    return docs.select(*apart, F.struct(*(c for c in docs.columns if c != "text")).alias("__row"))


def _unpacked(docs: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    return docs.select(*(changed[c].alias(c) if c in changed else F.col(c if c == "text" else f"__row.{c}").alias(c) for c in names))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _unpacked(quality_rules(_packed(docs, "text", "lang")).where("kept"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; n_chars is the length of what is left. Rows without an id come after all others."""
    n_chars = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return _unpacked(line_dedup(_packed(docs, "doc_id", "text")), docs.columns, n_chars=n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest id (one without an id if no row has one), of several such rows that with the smallest hash."""
    whole = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]  # a hash passes over nulls
    keys = ["__row_a", "__row_b"]
    keyed = docs.withColumns({"__row_a": F.xxhash64(*whole), "__row_b": F.xxhash64(F.lit("b"), *whole)})
    stay = stored(representatives(keyed.select("doc_id", "text", *keys), tuple(keys)))
    # Rows that are equal in all columns have the same hashes.
    return keyed.join(stay, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go, each row by its own text, also without an id."""
    hit = phrase_matches(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "text_hash")
    keys = [F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")), F.xxhash64("d.text") == F.col("h.text_hash")]
    return docs.alias("d").join(hit.alias("h"), keys, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces packed into sequences."""
    return best_fit_packing(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]
#: SQL can express neither near-dedup nor packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage read and stored on its way is deleted when its result is stored."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        discard(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
