"""Profiles of columns: coverage, size, cardinality, repetition, rare values, bounds."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.plans.frame import long_form

#: Symbols that count as missing.
MISSING = ("", "{}")
#: Repetition steps: how many values occur more often than each.
STEPS = (0, 1, 10, 100, 1000, 10_000, 100_000)


def coverage(df: DataFrame, features: Sequence[str], missing: Sequence[str] = MISSING) -> DataFrame:
    """feature, coverage: percent of values that are no missing symbol, per batch, mean over batches."""
    cells = long_form(df, features)
    there = F.avg(F.when(F.col("value").isin(*missing), 0.0).otherwise(1.0)) * 100
    return cells.groupBy("batch", "feature").agg(there.alias("c")).groupBy("feature").agg(F.avg("c").alias("coverage"))


def memory_size(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, bytes: mean UTF-8 length of the trimmed value per batch (null as None), mean over batches."""
    size = F.avg(F.octet_length(F.trim(F.coalesce("value", F.lit("None")))))
    return long_form(df, features).groupBy("batch", "feature").agg(size.alias("b")).groupBy("feature").agg(F.avg("b").alias("bytes"))


def cardinality(df: DataFrame, features: Sequence[str], approximate: float | None = None) -> DataFrame:
    """feature, cardinality: distinct values, empty and null ones left out; approximate: relative error."""
    value = F.when(F.col("value") != "", F.col("value"))
    n = F.approx_count_distinct(value, approximate) if approximate else F.count_distinct(value)
    return long_form(df, features).groupBy("feature").agg(n.alias("cardinality"))


def bounded_counts(df: DataFrame, features: Sequence[str], bound: int = 30_000) -> DataFrame:
    """feature, value, n: counts that all stop once ``bound`` distinct values have been seen, in order of idx."""
    cells = long_form(df, features)
    first = cells.groupBy("feature", "value").agg(F.min("idx").alias("first"))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy("first"))
    cut = first.withColumn("rank", rank).filter(F.col("rank") <= bound).filter(F.col("rank") == bound).select("feature", F.col("first").alias("cut"))
    kept = cells.join(cut, "feature", "left").filter(F.col("cut").isNull() | (F.col("idx") <= F.col("cut")))
    return kept.groupBy("feature", "value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, value, n over all rows."""
    return long_form(df, features).groupBy("feature", "value").agg(F.count("*").alias("n"))


def value_repetitions(counts: DataFrame, steps: Sequence[int] = STEPS) -> DataFrame:
    """feature, more_than_<n>: how many values occur more often than n."""
    return counts.groupBy("feature").agg(*(F.count_if(F.col("n") > s).alias(f"more_than_{s}") for s in steps))


def repetitions_json(repetitions: DataFrame) -> str:
    out = {}
    for r in repetitions.collect():
        d = r.asDict()
        out[d.pop("feature")] = {k.removeprefix("more_than_"): v for k, v in d.items()}
    return json.dumps(out)


def rare_values(df: DataFrame, features: Sequence[str], bound: int = 1) -> DataFrame:
    """feature, value, n of values that occur at most ``bound`` times."""
    return value_counts(df, features).filter(F.col("n") <= bound)


def sparsity(rare: DataFrame, cardinalities: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """feature, rare_percent (of its distinct values), kind."""
    few = rare.groupBy("feature").agg(F.count("*").alias("rare"))
    share = F.round(F.lit(100.0) * F.coalesce("rare", F.lit(0)) / F.expr("nullif(cardinality, 0)"), 2)
    kind = F.when(F.col("feature").isin(*numeric) if numeric else F.lit(False), "numeric").otherwise("nominal")
    return cardinalities.join(few, "feature", "left").select("feature", share.alias("rare_percent"), kind.alias("kind"))


def number(c: Column | str = "value") -> Column:
    return F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else F.try_to_number(c, F.lit("999"))


def numeric_bounds(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """batch, feature, minimum, maximum, mean, uniques (values that are no numbers count once)."""
    cells = long_form(df, features).withColumn("v", number("value"))
    odd = F.max(F.col("v").isNull().cast("int"))
    return cells.groupBy("batch", "feature").agg(F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.avg("v").alias("mean"), (F.count_distinct("v") + odd).alias("uniques"))


def nominal_bounds(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return long_form(df, features).groupBy("batch", "feature").agg(F.count_distinct("value").alias("uniques"))


def numeric_summary(bounds: DataFrame) -> DataFrame:
    """Over batches: feature, Minimum, Maximum, Median (of the batch means), uniques (mean, cut to a whole number)."""
    return bounds.groupBy("feature").agg(F.round(F.min("minimum"), 2).alias("minimum"), F.round(F.max("maximum"), 2).alias("maximum"), F.round(F.median("mean"), 2).alias("median"), F.floor(F.avg("uniques")).cast("long").alias("uniques"))


# Weights, resolutions and steps of proposed transformations.
WEIGHTS = (0.0, 0.5, 1.5, 2.0, 3.0, 10.0)
RESOLUTIONS = (0.1, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
BIN_STEPS = 15


def transformer_grid(summary: DataFrame) -> DataFrame:
    """Proposed transformations from a numeric summary: kind (weight, binner, ratio), features, grid of numbers."""
    weights = summary.select(F.lit("weight").alias("kind"), F.array("feature").alias("features"), F.lit(list(WEIGHTS)).cast("array<double>").alias("grid"))
    width = (F.col("maximum") - F.col("minimum")) / BIN_STEPS
    steps = F.transform(F.sequence(F.lit(0), F.lit(BIN_STEPS - 1)), lambda i: F.col("minimum") + i * width)
    bins = summary.filter("maximum > minimum").select(F.lit("binner").alias("kind"), F.array("feature").alias("features"), steps.alias("grid"))
    a, b = (summary.select(*(F.col(c).alias(f"{c}_{s}") for c in ("feature", "minimum", "maximum", "median"))) for s in "ab")
    m = F.col("median_a") + F.col("median_b")
    spectrum = F.array(F.lit(0.0), F.col("minimum_a") + F.col("minimum_b"), m / 10, m / 5, m, F.least("maximum_a", "maximum_b"))
    ratios = a.join(b, F.col("feature_a") != F.col("feature_b")).select(F.lit("ratio").alias("kind"), F.array("feature_a", "feature_b").alias("features"), F.array_sort(F.array_distinct(F.filter(spectrum, lambda x: x >= 0))).alias("grid"))
    return weights.union(bins).union(ratios)
