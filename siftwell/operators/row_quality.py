"""Row-level data quality: missing values, entropy, long fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTHS = (30, 60, 100, 200, 300)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a string; 0 for an empty or null one."""
    chars = F.array_sort(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""))

    def of(chars: Column) -> Column:
        n = F.size(chars)
        ends = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == n - 1) | (F.get(chars, i) != F.get(chars, i + 1)))
        step = lambda m, e: F.struct((e + 1).alias("at"), (m["h"] + (e + 1 - m["at"]) / n * F.log2(n.cast("double") / (e + 1 - m["at"]))).alias("h"))
        total = F.aggregate(ends, F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("h")), step, lambda m: m["h"])
        return F.when(n > 0, total).otherwise(F.lit(0.0))

    return F.get(F.transform(F.array(chars), of), F.lit(0))  # an array of one, so that the characters are sorted once


def row_scores(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Of each row: shares of empty, '{}', either and '0' fields, summed entropy, shares of fields over lengths."""
    values = F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields))
    share = lambda test: F.size(F.filter(values, test)) / F.lit(float(len(fields)))
    total = sum((entropy(F.col(f"`{c}`").cast("string")) for c in fields), F.lit(0.0))
    long = [(F.size(F.filter(values, _longer(n))) / F.lit(float(len(fields)))).alias(f"over_{n}") for n in LENGTHS]
    return df.select(*keep, share(lambda x: x == "").alias("empty"), share(lambda x: x == "{}").alias("empty_json"), share(lambda x: x.isin("", "{}")).alias("missing"), share(lambda x: x == "0").alias("zero"), total.alias("entropy"), *long)


def _longer(n: int):
    return lambda x: F.char_length(x) > n


def metric_histogram(rows: DataFrame, group: str, metric: str, bins: int = 100) -> DataFrame:
    """group, bin, percent: histogram of a metric in equal bins between its extremes in the group."""
    w = Window.partitionBy(group)
    low, high = F.min(metric).over(w), F.max(metric).over(w)
    at = F.when(high > low, F.least(F.floor((F.col(metric) - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(0)
    counted = rows.select(group, at.cast("int").alias("bin")).groupBy(group, "bin").agg(F.count("*").alias("n"))
    return counted.select(group, "bin", (F.lit(100.0) * F.col("n") / F.sum("n").over(w)).alias("percent"))
