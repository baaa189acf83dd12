"""The canonical frame: rows with a stable index and mini-batches, and its long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A last mini-batch that is not full is kept only with more rows than this.
TAIL = 1024


def with_index(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Adds idx, the 0-based place in the order of columns that together are unique.

    A numeric first column is cut at quantiles, so ranges are numbered apart and shifted by the counts of
    those before; any other order is numbered in one task.
    """
    kind = dict(df.dtypes)[order[0]]
    if kind in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        n = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        cuts = sorted(set(df.agg(F.percentile_approx(order[0], [i / n for i in range(1, n)], 1000)).first()[0] or [])) if n > 1 else []
        if cuts:
            df = df.withColumn("__range", sum((F.coalesce(F.col(order[0]) > c, F.lit(False)).cast("int") for c in cuts), F.lit(0)))
            counts = {r[0]: r[1] for r in df.groupBy("__range").count().collect()}
            shift, total = [], 0
            for i in range(len(cuts) + 1):
                shift.append(total)
                total += counts.get(i, 0)
            w = Window.partitionBy("__range").orderBy(*order)
            place = F.row_number().over(w) - 1 + F.get(F.lit(shift).cast("array<bigint>"), F.col("__range"))
            return df.withColumn("idx", place.cast("long")).drop("__range")
    return df.withColumn("idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def subsample(df: DataFrame, step: int) -> DataFrame:
    """Keeps each ``step``-th row by idx (1-based), and numbers what is kept anew."""
    if step <= 1:
        return df
    return df.filter((F.col("idx") + 1) % step == 0).withColumn("idx", F.floor((F.col("idx") + 1) / step) - 1)


def with_batches(df: DataFrame, size: int | None = None, tail: int = TAIL) -> DataFrame:
    """Adds batch and pos (place in it).  The last batch goes if it is neither full nor larger than ``tail``."""
    if size is None:
        return df.withColumn("batch", F.lit(0).cast("long")).withColumn("pos", F.col("idx"))
    df = df.withColumn("batch", F.floor(F.col("idx") / size)).withColumn("pos", F.col("idx") % size)
    rows = df.agg(F.max("idx")).first()[0]
    rows = 0 if rows is None else rows + 1
    left = rows % size
    return df.filter(F.col("batch") < rows // size) if 0 < left <= tail else df


def feature_focus(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """The listed features that exist, in name order, and the label."""
    wanted = {f for f in features if f in df.columns} | ({label} if label else set())
    return df.select(*(f"`{c}`" for c in sorted(wanted)))


def as_strings(df: DataFrame, features: Sequence[str]) -> list[Column]:
    return [F.col(f"`{f}`").cast("string").alias(f) for f in features]


def categorical(df: DataFrame, features: Sequence[str], order: Sequence[str], minibatch: int | None = None, step: int = 1) -> DataFrame:
    """batch, pos, idx and the features as strings: what the heuristics and profiles take."""
    df = with_index(df, order)
    df = with_batches(subsample(df, step), minibatch)
    return df.select("batch", "pos", "idx", *as_strings(df, features))


def long_form(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """batch, pos, idx, feature, value: a row for each feature of each row."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("value")) for f in features)))
    return df.select("batch", "pos", "idx", cells.alias("c")).select("batch", "pos", "idx", "c.feature", "c.value")
