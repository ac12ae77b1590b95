"""Operator 11, filter interaction audit: what each filter does at each place of each order.

A document is turned into its part, one failure flag a filter and its labels, and the counts of equal
rows of these are cubed over part and flags (SQL CUBE). A grouping set that keeps some flags, taken where
all of them are false, says how many documents survive just these filters, so the 2^n subsets of filters
have all their survivors from one pass. A filter at a place of an order leads from the subset before it to
the one with it: pairs of subsets are joined, and the steps of all orders are read off the pairs.

Whether a text is identical to an earlier document's is asked of 128 bit hashes: the smallest and the
largest id of each are partly taken before the shuffle, only hashes with several ids are stored and joined
back, broadcast if they are few by a count and else shuffled, where adaptive execution splits a hot one.

Defined results: a null text is empty; a null part counts as the empty string; a null doc_id is larger than
all others (it repeats any id, but no other null id); rows that share a doc_id are counted each and are no
earlier document for each other; a document with several labels has a label if one of them says so; null
labels say nothing; other columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import SPACE, small, stored, table, text_of

LEAST_WORDS = 50
#: Per cent: distinct words of all words (at least), capitals of all characters (at most).
DISTINCT_SHARE, CAPITAL_SHARE = 65, 5
SYMBOLS = "[#$%&*|]"
NO_ID = (1 << 63) - 1
#: What is counted besides the documents themselves.
MEASURES = ("good", "toxic")


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != "")


def repeats(docs: DataFrame, flag: str) -> DataFrame:
    """docs (id, h1, h2 and others) with the flag: another row of the same hash has a smaller id."""
    groups = docs.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    groups = stored(groups)
    return docs.join(small(groups, groups.count()), ["h1", "h2"], "left").withColumn(flag, F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("h1", "h2", "first")


def failure_flags(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """docs (doc_id, text, part) as part, good, toxic and the flags A to E of the five filters."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    rows = rows.select("id", "part", "text", word_list(F.col("text")).alias("words"))
    flags = rows.select(
        "id",
        "part",
        (F.size("words") < LEAST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")) < DISTINCT_SHARE * F.size("words")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > CAPITAL_SHARE * F.char_length("text")).alias("C"),
        F.col("text").rlike(SYMBOLS).alias("D"),
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(1), "text").alias("h2"),
    )
    flags = repeats(stored(flags), "E")
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    said = said.agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(m) for m, c in zip(MEASURES, ("quality", "toxic"), strict=True)))
    return flags.join(said, "id", "left").select("part", *"ABCDE", *(F.coalesce(m, F.lit(False)).alias(m) for m in MEASURES))


def survivors(flags: DataFrame, filters: list[str], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """How many of each part pass all filters of a subset: part, subset (a bit for each filter), n and one count a measure; zeros included.

    CUBE over the part and the flags. Rows of all parts together have a null part.
    """
    counts = ["n", *measures]
    whole = flags.groupBy("part", *filters).agg(F.count("*").alias("n"), *(F.count_if(m).alias(m) for m in measures))
    cubed = whole.cube("part", *filters).agg(*(F.sum(c).alias(c) for c in counts), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"without_{f}") for f in filters))
    for f in filters:
        cubed = cubed.where((F.col(f"without_{f}") == 1) | ~F.col(f))
    subset = sum((1 - F.col(f"without_{f}").cast("int")) * (1 << k) for k, f in enumerate(filters))
    found = stored(cubed.select("all_parts", "part", subset.alias("subset"), *counts))
    # The empty subset has a row for each part; from it come the subsets that nothing survives.
    grid = found.where("subset = 0").select("all_parts", "part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    keys = [F.col("g.subset") == F.col("f.subset"), F.col("g.all_parts") == F.col("f.all_parts"), F.col("g.part").eqNullSafe(F.col("f.part"))]
    return grid.alias("g").join(found.alias("f"), keys, "left").select("g.all_parts", "g.part", "g.subset", *(F.coalesce(f"f.{c}", F.lit(0)).cast("long").alias(c) for c in counts))


def pair_table(spark: SparkSession, filters: list[str]) -> DataFrame:
    """The pairs of subsets that one filter lies between, and in how many orders it does so there."""
    n = len(filters)
    rows = [(k, before, before | 1 << k, factorial(before.bit_count()) * factorial(n - 1 - before.bit_count())) for k in range(n) for before in range(1 << n) if not before >> k & 1]
    return spark.createDataFrame(rows, "filter int, before int, after int, orders long")


def step_table(spark: SparkSession, filters: list[str]) -> DataFrame:
    """Every order of the filters, step by step: filter_order, step, filter, before."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(filters[x] for x in order), step, k, before))
            before |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def filter_audit(flags: DataFrame, filters: list[str], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """flags (part, a boolean for each filter and measure) as part, all_parts, filter_order, step and the counts of the step.

    all_parts is 1 for the rows of all parts together, whose part is null. The work grows with n! of the n filters, which are few.
    """
    spark, counts = flags.sparkSession, ["n", *measures]
    alone = [(1 << len(filters)) - 1 - (1 << k) for k in range(len(filters))]  # all filters but one
    alive = stored(survivors(flags, filters, measures))
    paired = alive.join(F.broadcast(pair_table(spark, filters)), F.col("subset") == F.col("before"))
    keys = [F.col("b.after") == F.col("a.subset"), F.col("b.all_parts") == F.col("a.all_parts"), F.col("b.part").eqNullSafe(F.col("a.part"))]
    lost = [(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"{c}_removed") for c in counts]
    pairs = stored(paired.alias("b").join(alive.alias("a"), keys).select("b.all_parts", "b.part", "b.filter", "b.before", "b.orders", F.col("a.n").alias("kept"), *lost))
    of_filter = pairs.groupBy("all_parts", "part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("n_removed"))).alias("fails"),
        F.sum(F.when(F.col("before").isin(*alone), F.col("n_removed"))).alias("unique_fails"),
        F.sum(F.col("n_removed") * F.col("orders")).alias("shapley"),
    )
    keys = [F.col("l.all_parts") == F.col("f.all_parts"), F.col("l.part").eqNullSafe(F.col("f.part")), F.col("l.filter") == F.col("f.filter")]
    both = pairs.alias("l").join(of_filter.alias("f"), keys).select("l.*", "f.fails", "f.unique_fails", "f.shapley")
    return both.join(F.broadcast(step_table(spark, filters)), ["filter", "before"]).select(
        "part", "all_parts", "filter_order", "step", "kept", F.col("n_removed").alias("removed"), (F.col("fails") - F.col("n_removed")).alias("redundant"),
        "unique_fails", *(F.col(f"{m}_removed").alias(f"{m}_lost") for m in measures), "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The five filters on docs, as filter_audit gives it."""
    return filter_audit(failure_flags(docs, labels, part), list("ABCDE"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(docs, table(spark, sf_dir, "labels")).where("all_parts = 0").drop("all_parts")


ORACLE = {
    "op11_filter_audit": r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
flagged AS (
  SELECT part,
    [len(words) < 50,
     100 * len(list_distinct(words)) < 65 * len(words),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
     regexp_matches(text, '[#$%&*|]'),
     doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM docs LEFT JOIN labels USING (doc_id)),
letters AS (SELECT unnest(range(1, 6)) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS places
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT places, s AS step, places[s] AS f, places[1:s - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)),
kinds AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flagged GROUP BY part, fails),
judged AS (
  SELECT part, places, step, f, n, good, toxic, fails[f] AS bad,
    len([x FOR x IN before IF fails[x]]) > 0 AS gone,
    len([x FOR x IN fails IF x]) AS n_bad
  FROM kinds, steps),
counted AS (
  SELECT part, places, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS kept,
    coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND bad), 0) AS redundant,
    coalesce(sum(n) FILTER (bad AND n_bad = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND bad), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND bad), 0) AS toxic_lost
  FROM judged GROUP BY part, places, step, f)
SELECT part, array_to_string([chr(CAST(64 + x AS INTEGER)) FOR x IN places], '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
}
