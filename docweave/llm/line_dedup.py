"""Operator 6, line dedup.

Lines are exploded with their place, normalised and hashed; each hash gets its smallest and largest
document (a sum of two numbers that is partly taken before the shuffle, so that a line in a third of all
documents costs no more than others); hashes in several documents mark their lines for dropping, but in
the smallest document; the places to drop go back to their document, which is put together again from
the rest by position. Hashes have 128 bits.

Defined results: a null or empty text is one empty line and is kept; rows that share a doc_id count as
one document, each is cleaned by itself; all rows without a doc_id count together as one document that is
larger than all others, so a line that only they share stays; other columns stay as they are, but those named n_lines or n_dropped give way to the
added ones; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import lower_ascii, small, stored, table

MIN_LENGTH = 10
MIN_DOCUMENTS = 2
#: What a null doc_id counts as.
NO_ID = (1 << 63) - 1
BLANKS = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The places of the lines to drop, for each id and hash of text that has any: id, text_hash, drop (sorted)."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    lines = docs.select(doc.alias("id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(_lines(lower_ascii(F.col(text_col)))).alias("at", "line"))
    lines = lines.withColumn("key", F.btrim("line", F.lit(BLANKS))).where(F.char_length("key") >= min_length)
    lines = lines.select("id", "text_hash", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    if min_documents == 2:
        shared = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    else:
        shared = lines.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_documents).drop("n")
    # Stored, so that what it costs is known before the join: few keys are broadcast, many are shuffled, where a hot line's rows can be split.
    shared = stored(shared)
    return lines.join(small(shared, shared.count()), ["h1", "h2"]).where("id > first").groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs with the lines removed from their text; n_lines and n_dropped are added."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    drops = dropped_lines(docs, id_col, text_col, min_length, min_documents).withColumnsRenamed({"id": "__id", "text_hash": "__hash", "drop": "__drop"})
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__hash": F.xxhash64(text_col)})
    joined = keyed.join(drops, ["__id", "__hash"], "left").withColumn("__lines", _lines(F.col(text_col)))
    drop = F.coalesce("__drop", F.array().cast("array<int>"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), drop)
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(keep, lambda i: F.get("__lines", i)), "\n"))
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in names), F.size("__lines").cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op6_line_dedup": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)),
keyed AS (
  SELECT doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT a.doc_id, a.i, a.line, (b.k IS NOT NULL AND a.doc_id <> b.first) AS gone FROM keyed a LEFT JOIN shared b ON a.k = b.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
