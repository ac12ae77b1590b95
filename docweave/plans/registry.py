"""Queries by name, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The extensions that document names get in turn.
NAMES = (".pdf", ".jpg", ".png", ".xlsx", ".xls", ".doc", ".docx", ".md", ".zip", ".bin")
#: The same in SQL, over documents.
DOCS_SQL = "(SELECT *, concat('dir/doc_', doc_id, list_extract(['.pdf', '.jpg', '.png', '.xlsx', '.xls', '.doc', '.docx', '.md', '.zip', '.bin'], CAST(doc_id % 10 AS INTEGER) + 1)) AS path FROM documents)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a path, whose extension goes by the id."""
    ext = F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 10).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("dir/doc_"), F.col("doc_id").cast("string"), ext))
