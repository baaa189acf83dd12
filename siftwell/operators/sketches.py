"""Mergeable sketches: count-min, distinct counts, bounded counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.profile import bounded_counts  # noqa: F401  the bounded counter over a frame


def count_min(df: DataFrame, column: str, delta: str | None = None, depth: int = 6, width: int = 2**15) -> DataFrame:
    """row, cell, n: the matrix, one hash per row; delta: a column of (also negative) weights."""
    cells = df.select(F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"), F.col(column).cast("string").alias("v"), (F.col(delta) if delta else F.lit(1)).cast("long").alias("d"))
    return cells.groupBy("row", F.pmod(F.xxhash64("v", "row"), F.lit(width)).alias("cell")).agg(F.sum("d").alias("n"))


def merge(*matrices: DataFrame) -> DataFrame:
    out = matrices[0]
    for m in matrices[1:]:
        out = out.union(m)
    return out.groupBy("row", "cell").agg(F.sum("n").alias("n"))


def count_min_query(matrix: DataFrame, values: DataFrame, column: str, depth: int = 6, width: int = 2**15) -> DataFrame:
    """value, estimate: the least of a value's cells; 0 where a cell is unset."""
    asked = values.select(F.col(column).cast("string").alias("value")).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    asked = asked.withColumn("cell", F.pmod(F.xxhash64("value", "row"), F.lit(width)))
    return asked.join(matrix, ["row", "cell"], "left").groupBy("value").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def distinct_estimate(df: DataFrame, column: str) -> DataFrame:
    """column, estimate: the number of distinct values, exact at every size; null is none.

    Distinct values are found before they meet in a task, so no set of them is held anywhere and no sketch has
    to take over from some size on; ``distinct_sketch`` is the sketch.
    """
    values = df.select(F.col(column).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
    return values.agg(F.lit(column).alias("column"), F.count("*").alias("estimate"))


def distinct_sketch(df: DataFrame, column: str, p: int = 19) -> DataFrame:
    """column, estimate: distinct values by a mergeable HLL sketch of 2**p registers (error below 1 % from p = 14 on)."""
    value = F.col(column).cast("string")
    return df.agg(F.lit(column).alias("column"), F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(p))).alias("estimate"))
