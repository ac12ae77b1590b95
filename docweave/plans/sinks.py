"""What a run leaves: Markdown files, results as JSON files, written by the tasks that hold them and shown by one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import files
from docweave.operators.ranges import numbered_within
from docweave.sources.sink import commit_files
from docweave.sources.store import stored


def _folder(path: Column) -> Column:
    """The folder of a path, without a local file's scheme; entries of an archive belong to a folder with the archive's name beside it."""
    plain = F.regexp_replace(path, "^file:(//)?", "")
    opened = F.regexp_replace(plain, files.ENTRY.replace(r"\.zip)!", r")\.zip!"), "$1/$2")
    return F.regexp_extract(opened, "^(.*)/[^/]*$", 1)


def output_names(slots: DataFrame, out: str | None = None, ending: str = ".md", whole_name: bool = False) -> DataFrame:
    """slots (origin, sub, path) with out_file: the input's stem (or whole name) and the ending, in the folder out or beside the input. Of inputs that would share a file, the later ones get a number."""
    name = files.inner_name(F.col("path"))
    base = files.base_name(name) if whole_name else files.stem(name)
    folder = F.lit(out.rstrip("/")) if out else _folder(F.col("path"))
    named = slots.withColumns({"__folder": folder, "__base": base})
    placed = numbered_within(named, ["__folder", "__base"], ["origin", "sub", "path"], "__nth")  # very many may share a name
    numbered = F.when(F.col("__nth") > 1, F.concat(F.lit("."), F.col("__nth").cast("string"))).otherwise("")
    return placed.withColumn("out_file", F.concat("__folder", F.lit("/"), "__base", numbered, F.lit(ending))).drop("__folder", "__base", "__nth")


def write_markdown(rows: DataFrame, out: str | None = None) -> DataFrame:
    """rows (origin, sub, path, markdown) as .md files; gives path, out_file of those written."""
    named = stored(output_names(rows, out))
    commit_files(named.select(F.col("out_file").alias("path"), F.col("markdown").alias("content")))
    return named.select("path", "out_file")


def write_results(results: DataFrame, out: str) -> DataFrame:
    """Results of DocEngine (path and the columns of result.RESULT) as <name>.parsed.json in a folder; gives path, out_file."""
    body = [c for c in ("schema_version", "parsed_at", "parser_version", "source", "raw", "metrics", "warnings") if c in results.columns]
    whole = F.to_json(F.struct(*body), {"pretty": "true"})
    # What was extracted is JSON already and goes in as it is, before the last line.
    whole = F.when(F.col("extracted").isNull(), whole).otherwise(F.concat(F.left(whole, F.char_length(whole) - 2), F.lit(',\n  "extracted" : '), "extracted", F.lit("\n}")))
    rows = results.where("ok").select(F.col("path").alias("origin"), F.lit(0).alias("sub"), "path", whole.alias("content"))
    named = stored(output_names(rows, out, ".parsed.json", True))
    commit_files(named.select(F.col("out_file").alias("path"), "content"))
    return named.select("path", "out_file")
