"""Costs, confidences, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Prices for 1,000 tokens (prompt, completion, image) and the currency's rate.
PRICES = (
    ("qwen-plus", "CNY", 0.0008, 0.002, 0.0),
    ("qwen3.6-plus", "CNY", 0.0008, 0.002, 0.0),
    ("qwen-turbo", "CNY", 0.0003, 0.0006, 0.0),
    ("qwen-vl-max", "CNY", 0.02, 0.02, 0.02),
    ("qwen-vl-ocr-latest", "CNY", 0.005, 0.005, 0.005),
    ("gpt-4o", "USD", 0.0025, 0.01, 0.0),
    ("gpt-4o-mini", "USD", 0.00015, 0.0006, 0.0),
)
USD_TO_CNY = 7.2


def let(value: Column, body) -> Column:
    """body(value), where value is computed once."""
    return F.transform(F.array(value), body)[0]


def round_half_up(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def price_table(spark: SparkSession) -> DataFrame:
    """Seven rows, whatever the data; joins may broadcast it."""
    return spark.createDataFrame(PRICES, "model string, currency string, prompt_price double, completion_price double, image_price double")


def yuan(prompt: Column, completion: Column, image: Column) -> Column:
    """The cost of a call, over a row that is joined with its price; 0 for a model without one."""
    n = lambda c: F.coalesce(c, F.lit(0)) / 1000
    cost = n(prompt) * F.col("prompt_price") + n(completion) * F.col("completion_price") + n(image) * F.col("image_price")
    return F.coalesce(round_half_up(F.when(F.col("currency") == "USD", cost * USD_TO_CNY).otherwise(cost), 4), F.lit(0.0))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def confidence(raw: Column) -> Column:
    """Between 0 and 1; percentages become shares; null if it is no number."""
    return F.when(finite(raw), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(raw > 1, raw / 100).otherwise(raw))))


def mean_confidence(values: Column) -> Column:
    """Of the numbers among the values, to three digits; null if there is none."""
    good = F.filter(values, finite)
    return F.when(F.size(good) > 0, round_half_up(F.aggregate(good, F.lit(0.0), lambda a, b: a + b) / F.size(good), 3))


def bbox(points: Column) -> Column:
    """[x, y, width, height] of array<struct(x, y)>, null without points."""

    def around(good: Column) -> Column:
        x, y = F.transform(good, lambda p: p["x"]), F.transform(good, lambda p: p["y"])
        ends = F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), F.array_max(x).alias("x_end"), F.array_max(y).alias("y_end"))
        return F.when(F.size(good) > 0, let(ends, lambda e: F.array(e["x"], e["y"], e["x_end"] - e["x"], e["y_end"] - e["y"])))

    return let(F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), around)


def upper_median(values: Column) -> Column:
    """The middle value, of two the larger; 0 of none."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(0))
