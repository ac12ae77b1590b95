"""Calls to models, added up and priced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docweave.functions.numbers import price_table, round_half_up, yuan
from docweave.operators.ranges import highest_sum


def priced(calls: DataFrame) -> DataFrame:
    """calls (model, prompt_tokens, completion_tokens, image_tokens) with yuan, rounded for each call. The price table has seven rows."""
    joined = calls.join(F.broadcast(price_table(calls.sparkSession)), "model", "left")
    return joined.withColumn("yuan", yuan(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("image_tokens"))).select(*calls.columns, "yuan")


def calls_by_model(calls: DataFrame) -> DataFrame:
    """model, calls, prompt_tokens, completion_tokens, image_tokens, retries, yuan."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    return priced(calls).groupBy("model").agg(F.count("*").alias("calls"), total("prompt_tokens"), total("completion_tokens"), total("image_tokens"), total("retries"), F.sum("yuan").alias("yuan"))


def total_cost(calls: DataFrame) -> DataFrame:
    """total_yuan (each call is rounded before the sum, the sum once more), calls."""
    return priced(calls).agg(round_half_up(F.sum("yuan"), 4).alias("total_yuan"), F.count("*").alias("calls"))


def peak_in_flight(calls: DataFrame, keys: list[str], began: str = "started_ms", ms: str = "ms") -> DataFrame:
    """keys, peak: the most calls (from began on, for ms, a call of no time for one) that were open at once; one that ends when another begins is not open with it."""
    edges = calls.select(*keys, F.explode(F.array(F.struct(F.col(began).alias("at"), F.lit(1).alias("d")), F.struct((F.col(began) + F.greatest(F.col(ms), F.lit(1))).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.at", "e.d")
    steps = edges.groupBy(*keys, "at").agg(F.sum("d").alias("d"))  # equal times become one step before they are put in order
    return highest_sum(steps, keys, "at", "d", "peak")


def peak_of(calls: Column) -> Column:
    """The same of one array of calls."""
    edges = F.flatten(F.transform(calls, lambda c: F.array(F.struct(c["started_ms"].alias("at"), F.lit(1).alias("d")), F.struct((c["started_ms"] + F.greatest(c["ms"], F.lit(1))).alias("at"), F.lit(-1).alias("d")))))
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("peak"))  # ends come before beginnings at the same time
    return F.aggregate(F.array_sort(edges), none, lambda a, e: F.struct((a["now"] + e["d"]).alias("now"), F.greatest(a["peak"], a["now"] + e["d"]).alias("peak")))["peak"].cast("long")


def quality(field_count: Column, full_text: Column, seals: Column, signatures: Column, warnings: Column) -> Column:
    """What a result holds. The reference values of confidence are 0 unless a caller computes them (confidence_quality)."""
    n = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("long")
    zero = F.lit(0.0)
    return F.struct(
        field_count.cast("long").alias("field_count"), F.lit(0).cast("long").alias("fields_above_confidence"), zero.alias("avg_confidence"), zero.alias("locator_resolve_rate"),
        F.coalesce(F.char_length(full_text), F.lit(0)).cast("long").alias("ocr_chars"), n(seals).alias("seals"), n(signatures).alias("signatures"), n(warnings).alias("warnings"),
    )


def field_count(extracted: Column) -> Column:
    """The top keys of an object in JSON; 0 without one."""
    return F.coalesce(F.size(F.json_object_keys(extracted)), F.lit(0)).cast("long")


def performance(calls: DataFrame, keys: list[str]) -> DataFrame:
    """calls (keys, stage: extract, ocr, seal or llm; ms, retries) as keys and the sums of each stage, retries and images (calls of ocr and seal)."""
    of = lambda stage: F.sum(F.when(F.col("stage") == stage, F.col("ms")).otherwise(0)).cast("long").alias(f"{stage}_ms")
    return calls.groupBy(*keys).agg(
        F.sum("ms").cast("long").alias("total_ms"), *(of(s) for s in ("extract", "ocr", "seal", "llm")),
        F.sum(F.coalesce("retries", F.lit(0))).cast("long").alias("retries"), F.count_if(F.col("stage").isin("ocr", "seal")).alias("images"),
    )


def performance_of(calls: Column) -> dict[str, Column]:
    """The same of one array of calls, by name."""
    add = lambda of, c: F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[c], F.lit(0)))
    of = lambda *stages: F.filter(calls, lambda x: x["stage"].isin(*stages))
    return {"total_ms": add(calls, "ms"), **{f"{s}_ms": add(of(s), "ms") for s in ("extract", "ocr", "seal", "llm")}, "retries": add(calls, "retries"), "images": F.size(of("ocr", "seal")).cast("long")}


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """Results (ok, metrics) and what will be known of them with the action that writes or counts them: files, ok, failed, total_ms, retries, images, yuan."""
    seen, of = Observation(), lambda c: F.coalesce(F.sum(c), F.lit(0))
    return results.observe(
        seen, F.count("*").alias("files"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), of("metrics.performance.total_ms").alias("total_ms"),
        of("metrics.performance.retries").alias("retries"), of("metrics.performance.images").alias("images"), of("metrics.cost.total_yuan").alias("yuan"),
    ), seen


def rolled_up(perf: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """The sums of columns for each value of by, and for all (by is null there, and total true)."""
    return perf.rollup(by).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in columns), (F.grouping(by) == 1).alias("total"))
