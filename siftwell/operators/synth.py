"""Synthetic categorical data with known dependencies, noise and drift, all seeded columns over a range."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import exp

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform_matrix(spark: SparkSession, rows: int, features: int, seed: int = 0, low: int = 10, high: int = 100) -> DataFrame:
    """idx and f0..: whole numbers in [low, high)."""
    return spark.range(rows).select(F.col("id").alias("idx"), *((F.floor(F.rand(seed + i) * (high - low)) + low).cast("int").alias(f"f{i}") for i in range(features)))


def naive(spark: SparkSession, rows: int, features: int, seed: int = 0) -> DataFrame:
    """label: column 30 (the last, if fewer) above 40; the column itself is the label, too."""
    needle = f"f{min(30, features - 1)}"
    df = uniform_matrix(spark, rows, features, seed)
    return df.withColumn("label", (F.col(needle) >= 40).cast("int")).withColumn(needle, F.col("label"))


def benchmark(spark: SparkSession, rows: int, features: int = 100, order: int = 1, seed: int = 0) -> DataFrame:
    """label by column 30, by columns 30 and 50, or by 30, 50 and 20; of order 1, column 31 is 19 times 30."""
    df = uniform_matrix(spark, rows, features, seed)
    if order == 1:
        df = df.withColumn("f31", F.col("f30") * 19)
    parts = ["f30", "f50", "f20"][:order]
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.withColumn("label", F.when(F.col("f30") < 20, 0).otherwise(F.col("f30")) if order == 1 else total)


def feature(name: str, values: Sequence[float], weights: Sequence[float] | None = None, ensure: bool = False, seed: int = 0) -> Column:
    """A column of values drawn with weights; ensure: each occurs, in the first rows."""
    weights = [1.0] * len(values) if weights is None else list(weights)
    if len(weights) != len(values):
        raise ValueError("a weight for each value")
    total, at, bounds = sum(weights), 0.0, []
    for w in weights:
        at += w / total
        bounds.append(at)
    u = F.rand(seed)
    place = F.size(F.filter(F.lit(bounds[:-1]).cast("array<double>"), lambda b: b <= u)) if len(values) > 1 else F.lit(0)
    drawn = F.get(F.lit(list(values)), place)
    if ensure:
        drawn = F.when(F.col("idx") < len(values), F.get(F.lit(list(values)), F.col("idx").cast("int"))).otherwise(drawn)
    return drawn.alias(name)


def normal_weights(values: Sequence[float], centre: float, k: float = 10.0) -> list[float]:
    scale = max(1e-9, len(values) / k)
    return [exp(-((v - centre) ** 2) / (2 * scale * scale)) + 1e-12 for v in values]


def categorical(spark: SparkSession, rows: int, features: int, cardinality: int = 5, ensure: bool = False, structure: dict[int, tuple[Sequence[float], Sequence[float] | None]] | None = None, seed: int = 0) -> DataFrame:
    """idx and f0..; structure: values and weights of chosen features."""
    structure = structure or {}
    made = []
    for i in range(features):
        values, weights = structure.get(i, (list(range(cardinality)), None))
        made.append(feature(f"f{i}", list(values), weights, ensure, seed + i))
    return spark.range(rows).select(F.col("id").alias("idx")).select("idx", *made)


def combination(df: DataFrame, columns: Sequence[str], name: str, how: str | Callable[[list[Column]], Column] = "linear") -> DataFrame:
    cols = [F.col(c) for c in columns]
    if callable(how):
        return df.withColumn(name, how(cols))
    total = sum(cols[1:], cols[0])
    if how not in ("linear", "nonlinear"):
        raise ValueError(f"no combination is called {how}")
    return df.withColumn(name, F.sin(total) if how == "nonlinear" else total)


def bitwise(df: DataFrame, columns: Sequence[str], name: str, how: str) -> DataFrame:
    """xor, and, or of columns."""
    out = F.col(columns[0])
    for c in columns[1:]:
        out = {"xor": out.bitwiseXOR, "and": out.bitwiseAND, "or": out.bitwiseOR}[how](F.col(c))
    return df.withColumn(name, out)


def correlated(df: DataFrame, column: str, name: str, r: float, seed: int = 0) -> DataFrame:
    """A column of Pearson correlation r with another: standardised noise made orthogonal to it by two aggregates."""
    s = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s")).first()
    df = df.withColumn("__t", (F.col(column) - s.m) / (s.s or 1.0)).withColumn("__e", F.randn(seed))
    k = df.agg(F.sum(F.col("__e") * F.col("__t")).alias("et"), F.sum(F.col("__t") * F.col("__t")).alias("tt"), F.avg("__e").alias("me")).first()
    rest = F.col("__e") - k.me - F.lit(k.et / (k.tt or 1.0)) * F.col("__t")
    df = df.withColumn("__r", rest)
    d = df.agg(F.stddev_pop("__r")).first()[0] or 1.0
    return df.withColumn(name, r * F.col("__t") + (1 - r * r) ** 0.5 * F.col("__r") / d).drop("__t", "__e", "__r")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *(F.col(c).alias(f"{c}_copy") for c in columns))


def labels(df: DataFrame, columns: Sequence[str], classes: int = 2, shares: Sequence[float] | None = None, how: str | Callable[[list[Column]], Column] = "linear", k: float = 1.0, name: str = "label") -> DataFrame:
    """Classes by percentiles of a decision value of the columns, or clusters (how = "cluster")."""
    if how == "cluster":
        return clusters(df, columns, classes, name)
    cols = [F.col(c).cast("double") for c in columns]
    if callable(how):
        value = how(cols)
    elif how == "linear":
        value = sum((2 * c + 3 for c in cols), F.lit(0.0))
    elif how == "nonlinear":
        value = sum((k * F.sin(c) + k * F.cos(c) for c in cols), F.lit(0.0))
    else:
        raise ValueError(f"no labels are made by {how}")
    shares = list(shares) if shares else [1 / classes] * classes
    at, cuts = 0.0, []
    for s in shares[:-1]:
        at += s
        cuts.append(min(at, 1.0))
    df = df.withColumn("__v", value)
    bounds = df.agg(F.percentile("__v", F.lit(cuts).cast("array<double>"))).first()[0] if cuts else []
    return df.withColumn(name, sum(((F.col("__v") > b).cast("int") for b in bounds), F.lit(0))).drop("__v")


def clusters(df: DataFrame, columns: Sequence[str], classes: int, name: str = "label", balance: bool = False, seed: int = 0) -> DataFrame:
    """K-means clusters; balance: members farthest from the centre leave clusters above the mean size."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="__x").transform(df)
    model = KMeans(k=classes, seed=seed, featuresCol="__x", predictionCol=name).fit(rows)
    out = model.transform(rows)
    if balance:
        centres = F.lit([[float(x) for x in c] for c in model.clusterCenters()])
        from pyspark.ml.functions import vector_to_array

        gap = F.aggregate(F.zip_with(vector_to_array("__x"), F.get(centres, F.col(name)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda m, v: m + v)
        size = -(-df.count() // classes)
        place = F.row_number().over(Window.partitionBy(name).orderBy(gap, "idx"))
        out = out.withColumn("__p", place)
        over = out.filter(F.col("__p") > size)
        counts = {r[0]: r[1] for r in out.filter(F.col("__p") <= size).groupBy(name).count().collect()}
        seats = [c for c in range(classes) for _ in range(size - counts.get(c, 0))]
        moved = over.withColumn("__s", F.row_number().over(Window.orderBy("idx")) - 1).withColumn(name, F.get(F.lit(seats or [0]), F.col("__s"))).drop("__s")
        out = out.filter(F.col("__p") <= size).unionByName(moved).drop("__p")
    return out.drop("__x")


def with_noise(df: DataFrame, columns: Sequence[str], kind: str, p: float | Column = 0.1, label: str = "label", seed: int = 0, rows: int | None = None) -> DataFrame:
    """Noise in columns: missing, categorical (a value of another class), cardinality (new values),
    value_drift (likelier with idx), frequency_drift (in the last three of four parts)."""
    n = rows or df.count()
    out = df
    for i, c in enumerate(columns):
        hit = F.rand(seed + 7 * i + 1)
        col = F.col(c)
        if kind == "missing":
            new = F.when(hit < p, F.lit(None)).otherwise(col)
        elif kind == "categorical":
            values = [r[0] for r in df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(1000).select(c).collect()]
            other = F.get(F.lit(values), F.floor(F.rand(seed + 7 * i + 2) * len(values)).cast("int"))
            new = F.when(hit < p, other).otherwise(col)
        elif kind == "cardinality":
            top = df.agg(F.max(c)).first()[0] or 0
            new = F.when(hit < p, top + 1 + F.floor(F.rand(seed + 7 * i + 3) * 100)).otherwise(col)
        elif kind == "value_drift":
            new = F.when(hit < p * F.col("idx") / max(1, n - 1), col + 1).otherwise(col)
        elif kind == "frequency_drift":
            value = df.groupBy(c).count().orderBy(F.desc("count"), c).first()[0]
            new = F.when((F.floor(F.col("idx") * 4 / n) >= 1) & (hit < p), F.lit(value)).otherwise(col)
        else:
            raise ValueError(f"no noise is called {kind}")
        out = out.withColumn(c, new)
    return out


def downsampled(df: DataFrame, n: int, label: str = "label", seed: int = 0) -> DataFrame:
    """n rows of each class, drawn with replacement; n above the smallest class is a ValueError."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if n > min(counts.values()):
        raise ValueError("n is above the smallest class")
    placed = df.withColumn("__p", F.row_number().over(Window.partitionBy(label).orderBy("idx")))
    sizes = df.sparkSession.createDataFrame([(k, v) for k, v in counts.items()], f"__l {dict(df.dtypes)[label]}, __n long")
    draws = sizes.withColumn("__d", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__q", F.floor(F.rand(seed) * F.col("__n")) + 1)
    return placed.join(draws, (placed[label] == draws["__l"]) & (placed["__p"] == draws["__q"])).select(*df.columns)


def deteriorated(df: DataFrame, columns: Sequence[str], how: str = "temporal", p: float = 0.5, kind: str = "missing", seed: int = 0) -> DataFrame:
    """Noise that grows with rows (temporal), exponentially with them (sample_based) or with columns (feature_based)."""
    n = max(1, df.count() - 1)
    if how == "feature_based":
        for i, c in enumerate(columns):
            df = with_noise(df, [c], kind, p * (i + 1) / len(columns), seed=seed + i)
        return df
    if how not in ("temporal", "sample_based"):
        raise ValueError(f"nothing deteriorates {how}")
    progress = F.col("idx") / n
    return with_noise(df, columns, kind, p * progress if how == "temporal" else p * (F.exp(progress) - 1) / (exp(1) - 1), seed=seed)


def cardinality_drift(df: DataFrame, column: str, how: str = "increase", strength: float = 0.5, seed: int = 0) -> DataFrame:
    n = max(1, df.count() - 1)
    progress = F.col("idx") / n
    s = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    if how == "increase":
        return df.withColumn(column, F.when(F.rand(seed) < strength * progress, s.high + 1 + F.floor(F.rand(seed + 1) * 50)).otherwise(F.col(column)))
    if how == "decrease":
        return df.withColumn(column, F.when(F.rand(seed) < strength * progress, s.low).otherwise(F.col(column)))
    if how == "oscillate":
        wave = (F.sin(4 * 3.141592653589793 * progress) + 1) / 2
        return df.withColumn(column, F.when(F.rand(seed) < strength * wave, s.high + 1 + F.floor(F.rand(seed + 1) * 50)).otherwise(F.col(column)))
    raise ValueError(f"no drift is called {how}")


__all__ = ["benchmark", "bitwise", "cardinality_drift", "categorical", "clusters", "combination", "correlated", "deteriorated", "downsampled", "duplicates", "feature", "labels", "naive", "normal_weights", "uniform_matrix", "with_noise"]
