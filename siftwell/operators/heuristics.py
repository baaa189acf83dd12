"""Scores of pairs of categorical columns, from one contingency aggregate per batch and pair.

The first of a pair is the feature (y), the second the one that conditions (x, usually the label); natural
logarithms.  Null is a category of its own.  All scores are Column arithmetic over counts, so the rows are
read once and aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEURISTICS = ("MI", "MI-numba-randomized", "MI-numba", "MI-numba-3mr", "max-value-coverage", "correlation-Pearson", "AMI", "Constant")


def _cells(pairs: Sequence[tuple[str, str]]) -> Column:
    part = lambda p: F.struct(F.lit(p[0]).alias("FeatureA"), F.lit(p[1]).alias("FeatureB"), F.col(f"`{p[0]}`").alias("y"), F.col(f"`{p[1]}`").alias("x"))
    return F.explode(F.array(*(part(p) for p in pairs)))


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """batch, FeatureA, FeatureB, y, x, n and the margins ny, nx, total."""
    pairs = list(dict.fromkeys(pairs))
    cells = df.select("batch", _cells(pairs).alias("c")).select("batch", "c.*")
    counts = cells.groupBy("batch", "FeatureA", "FeatureB", "y", "x").agg(F.count("*").alias("n"))
    w = Window.partitionBy("batch", "FeatureA", "FeatureB")
    return counts.select("*", F.sum("n").over(w.partitionBy("batch", "FeatureA", "FeatureB", "y")).alias("ny"), F.sum("n").over(w.partitionBy("batch", "FeatureA", "FeatureB", "x")).alias("nx"), F.sum("n").over(w).alias("total"))


def _by_pair(counts: DataFrame, score: Column) -> DataFrame:
    return counts.groupBy("batch", "FeatureA", "FeatureB").agg(score.alias("Score"))


def mutual_information(df: DataFrame, pairs: Sequence[tuple[str, str]], clip: bool = True) -> DataFrame:
    """Plain mutual information; ``clip``: not below 0."""
    mi = F.expr("sum(n / total * ln(total * CAST(n AS DOUBLE) / (CAST(nx AS DOUBLE) * ny)))")
    return _by_pair(contingency(df, pairs), F.greatest(mi, F.lit(0.0)) if clip else mi)


def max_value_coverage(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The share of the commonest pair of values."""
    return _by_pair(contingency(df, pairs), F.expr("max(n) / max(total)"))


def _coded(counts: DataFrame) -> DataFrame:
    """Adds the category codes cy and cx: place among the distinct values by code points, null -1."""
    code = lambda c: F.when(F.col(c).isNull(), -1).otherwise(F.dense_rank().over(Window.partitionBy("batch", "FeatureA", "FeatureB").orderBy(F.col(c).asc_nulls_last())) - 1).cast("double")
    return counts.withColumn("cy", code("y")).withColumn("cx", code("x"))


def pearson_of_codes(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson's correlation of category codes; null where a column has one value."""
    s = lambda e: f"sum(n * {e})"
    top = f"max(total) * {s('cx * cy')} - {s('cx')} * {s('cy')}"
    under = f"(max(total) * {s('cx * cx')} - {s('cx')} * {s('cx')}) * (max(total) * {s('cy * cy')} - {s('cy')} * {s('cy')})"
    return _by_pair(_coded(contingency(df, pairs)), F.expr(f"({top}) / nullif(sqrt({under}), 0D)"))


def randomized_mutual_information(df: DataFrame, pairs: Sequence[tuple[str, str]], ratio: float = 1.0) -> DataFrame:
    """Mutual information less that of a deterministic background.

    For each value x of the second column (n_x > 1 rows), row i of it borrows the first column's value at row
    (i + n_x) mod N.  Score: sum over x of n_x / N * (H(borrowed | x) - H(own | x)).  Where both columns' category codes have equal
    sums (a column with itself, above all), the borrowed side is left out: H(y) - H(y | x).
    ``ratio`` below 1: only the first int(int(ratio * N) / number of x) rows of each x count, n_x and N stay;
    the score is multiplied by it.

    Rows meet the rows they borrow from in one join per distinct second column, for all its features at once.
    """
    out = None
    for x in dict.fromkeys(p[1] for p in pairs):
        features = list(dict.fromkeys(p[0] for p in pairs if p[1] == x))
        part = _randomized(df, features, x, ratio)
        out = part if out is None else out.union(part)
    return out


def _randomized(df: DataFrame, features: list[str], label: str, ratio: float) -> DataFrame:
    named = [f"f{i}" for i in range(len(features))]
    wide = df.select("batch", "pos", F.col(f"`{label}`").alias("x"), *(F.col(f"`{f}`").alias(n) for f, n in zip(features, named, strict=True)))
    sizes = wide.groupBy("batch", "x").agg(F.count("*").alias("nx"))
    w = Window.partitionBy("batch")
    sizes = sizes.select(F.col("batch").alias("bs"), F.col("x").alias("xs"), "nx", F.sum("nx").over(w).alias("total"), F.count("*").over(w).alias("values"))
    rows = wide.join(sizes, (F.col("batch") == F.col("bs")) & F.col("x").eqNullSafe(F.col("xs"))).select("batch", "pos", "x", "nx", "total", "values", *named)
    if ratio < 1:
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("batch", "x").orderBy("pos")))
        k = F.floor(F.floor(F.col("total") * ratio) / F.col("values"))
        rows = rows.filter((k == 0) | (F.col("r") <= k)).drop("r")
    lent = wide.select(F.col("batch").alias("b2"), F.col("pos").alias("p2"), *(F.col(n).alias(f"{n}_lent") for n in named))
    rows = rows.join(lent, (F.col("batch") == F.col("b2")) & ((F.col("pos") + F.col("nx")) % F.col("total") == F.col("p2")))
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("FeatureA"), F.col(n).alias("own"), F.col(f"{n}_lent").alias("lent")) for f, n in zip(features, named, strict=True))))
    cells = rows.select("batch", "x", "nx", "total", cells.alias("c")).select("batch", "x", "nx", "total", "c.*")
    sides = cells.select("batch", "x", "nx", "total", "FeatureA", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("own").alias("y")), F.struct(F.lit(-1).alias("side"), F.col("lent").alias("y")))).alias("s")).select("batch", "x", "nx", "total", "FeatureA", "s.*")
    counts = sides.groupBy("batch", "FeatureA", "side", "x", "y").agg(F.count("*").alias("n"), F.max("nx").alias("nx"), F.max("total").alias("total"))
    entropy = counts.filter("nx > 1").groupBy("batch", "FeatureA").agg(F.expr("sum(side * CAST(n AS DOUBLE) / total * ln(CAST(n AS DOUBLE) / nx))").alias("gain"))
    own = counts.filter("side = 1").select("batch", "FeatureA", F.lit(label).alias("FeatureB"), "y", "x", "n", "nx", "total")
    plain = own.withColumn("ny", F.sum("n").over(Window.partitionBy("batch", "FeatureA", "y"))).withColumn("kept", F.sum("n").over(Window.partitionBy("batch", "FeatureA")))
    coded = _coded(plain).groupBy("batch", "FeatureA").agg(F.expr("sum(n * cx) = sum(n * cy)").alias("same"), F.expr("sum(CAST(n AS DOUBLE) / total * IF(nx > 1, ln(CAST(n AS DOUBLE) / nx), 0D)) - sum(CAST(n AS DOUBLE) / kept * ln(CAST(ny AS DOUBLE) / kept))").alias("plain"))
    both = coded.join(entropy, ["batch", "FeatureA"], "left")
    score = F.when(F.col("same"), F.col("plain")).otherwise(F.coalesce("gain", F.lit(0.0))) * F.lit(float(ratio))
    return both.select("batch", "FeatureA", F.lit(label).alias("FeatureB"), score.alias("Score"))


def adjusted_mutual_information(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(MI - E[MI]) / ((H(x) + H(y)) / 2 - E[MI]), E by the hypergeometric law; 1 where both have one value.

    The expectation is summed over distinct pairs of margins, weighted by how often they occur.
    """
    counts = contingency(df, pairs)
    key = ["batch", "FeatureA", "FeatureB"]
    base = counts.groupBy(*key).agg(F.expr("sum(n / total * ln(total * CAST(n AS DOUBLE) / (CAST(nx AS DOUBLE) * ny)))").alias("mi"), F.max("total").alias("total"))
    margins = {}
    for side in ("x", "y"):
        one = counts.select(*key, side, F.col(f"n{side}").alias("m"), "total").distinct()
        margins[side] = one.groupBy(*key, "m", "total").agg(F.count("*").alias("times"))
    entropy = lambda t, name: t.groupBy(*key).agg(F.expr("-sum(times * CAST(m AS DOUBLE) / total * ln(CAST(m AS DOUBLE) / total))").alias(name), F.sum("times").alias(f"{name}_values"))
    a = margins["x"].select(*key, F.col("m").alias("a"), F.col("times").alias("ta"), "total")
    b = margins["y"].select(*key, F.col("m").alias("b"), F.col("times").alias("tb"))
    lf = _ln_factorial
    cells = a.join(b, key).withColumn("k", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("a") + F.col("b") - F.col("total")), F.least("a", "b"))))
    N, A, B, K = (F.col(c) for c in ("total", "a", "b", "k"))
    weight = F.exp(lf(A) + lf(B) + lf(N - A) + lf(N - B) - lf(N) - lf(K) - lf(A - K) - lf(B - K) - lf(N - A - B + K))
    expected = cells.groupBy(*key).agg(F.sum(F.col("ta") * F.col("tb") * K / N * F.ln(N * K.cast("double") / (A.cast("double") * B)) * weight).alias("e"))
    joined = base.join(entropy(margins["x"], "hx"), key).join(entropy(margins["y"], "hy"), key).join(expected, key)
    score = F.expr("IF(hx_values = 1 AND hy_values = 1, 1D, (mi - e) / nullif((hx + hy) / 2 - e, 0D))")
    return joined.select(*key, score.alias("Score"))


def _ln_factorial(c: Column) -> Column:
    """ln c! by Stirling's series from 20 on (error below 1e-13), exactly below."""
    from math import lgamma, pi

    small = F.get(F.lit([lgamma(i + 1) for i in range(21)]).cast("array<double>"), F.least(c, F.lit(20)))
    x = F.greatest(c, F.lit(1)).cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(c <= 20, small).otherwise(series)


def constant(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(a, b) for a, b in pairs], "FeatureA string, FeatureB string").select(F.lit(0).cast("long").alias("batch"), "FeatureA", "FeatureB", F.lit(0.0).alias("Score"))


def collapsed(columns: Sequence[Column]) -> Column:
    """Several columns of codes as one: abs(max - sum) of a row."""
    return F.abs((F.greatest(*columns) if len(columns) > 1 else columns[0]) - sum(columns[1:], columns[0]))


def scores(df: DataFrame, pairs: Sequence[tuple[str, str]], heuristic: str = "MI-numba-randomized", ratio: float = 1.0) -> DataFrame:
    """batch, FeatureA, FeatureB, Score by the named heuristic; an unknown name is a ValueError."""
    if heuristic == "MI":
        return mutual_information(df, pairs)
    if heuristic == "MI-numba-randomized":
        return randomized_mutual_information(df, pairs, ratio)
    if heuristic in ("MI-numba", "MI-numba-3mr"):
        return mutual_information(df, pairs, clip=False)
    if heuristic == "max-value-coverage":
        return max_value_coverage(df, pairs)
    if heuristic == "correlation-Pearson":
        return pearson_of_codes(df, pairs)
    if heuristic == "AMI":
        return adjusted_mutual_information(df, pairs)
    if heuristic == "Constant":
        return constant(df, pairs)
    if heuristic.startswith("surrogate-"):
        from siftwell.operators.surrogates import surrogate_scores

        return surrogate_scores(df, pairs, heuristic)
    raise ValueError(f"no heuristic is called {heuristic}")
