"""Scores by a surrogate model: how well a feature alone predicts the label, in two folds.

Score: 1 + median over folds of the mean log-likelihood.  Variants: plain logistic regression on one-hot
values, the same on a hashed random projection (RP) or on leading components (SVD), and a linear support
vector machine, one per class above two, whose margins are scaled to probabilities (SVM; Spark has no kernel machine).
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import median

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import PCA, FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block when a label's rows are halved.
BLOCK = 1 << 16
SURROGATES = ("surrogate-SGD", "surrogate-SVM", "surrogate-SGD-RP", "surrogate-SGD-SVD", "surrogate-LR", "surrogate-SGD-prior")


def _pipeline(columns: list[str], kind: str) -> list:
    if kind == "surrogate-SGD-RP":
        return [FeatureHasher(inputCols=columns, outputCol="features", numFeatures=1024, categoricalCols=columns)]
    index = StringIndexer(inputCols=columns, outputCols=[f"{c}_i" for c in columns], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in columns], outputCols=[f"{c}_h" for c in columns], handleInvalid="keep")
    name = "wide" if kind == "surrogate-SGD-SVD" else "features"
    return [index, hot, VectorAssembler(inputCols=[f"{c}_h" for c in columns], outputCol=name)]


def _halves(rows: DataFrame) -> DataFrame:
    """Adds fold: 1 for the first half of a label's rows by idx, 2 for the rest.

    Blocks of rows are counted per label; only the block in which a label's middle lies is numbered row by row.
    """
    rows = rows.withColumn("block", F.floor(F.col("idx") / BLOCK))
    order = Window.partitionBy("y").orderBy("block")
    blocks = rows.groupBy("y", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("y", "block", (F.sum("n").over(order) - F.col("n")).alias("before"), "n", F.ceil(F.sum("n").over(Window.partitionBy("y")) / 2).alias("half"))
    middle = blocks.filter("before < half AND half <= before + n").select("y", "block", (F.col("half") - F.col("before")).alias("place"))
    numbered = rows.join(middle, ["y", "block"]).withColumn("r", F.row_number().over(Window.partitionBy("y", "block").orderBy("idx")))
    cut = numbered.filter("r = place").select("y", F.col("idx").alias("cut"))
    return rows.join(cut, "y").withColumn("fold", F.when(F.col("idx") <= F.col("cut"), 1).otherwise(2)).drop("block", "cut")


def surrogate_score(df: DataFrame, columns: Sequence[str], label: str, kind: str = "surrogate-SGD") -> float:
    """columns: the feature and, with a reference model, its features.

    Rows of all batches count as one.  Models are fitted on distinct combinations of values, label and fold,
    weighted by their rows, so a fit costs what the combinations cost and not what the rows do.  A null value
    or label counts as an empty one.
    """
    if kind not in SURROGATES:
        raise ValueError(f"no surrogate is called {kind}")
    names = [f"c{i}" for i in range(len(columns))]
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = _halves(df.select("idx", text(label).alias("y"), *(text(c).alias(n) for c, n in zip(columns, names, strict=True))))
    rows = rows.groupBy(*names, "y", "fold").agg(F.count("*").cast("double").alias("w")).persist()
    try:
        return _fitted(rows, names, kind)
    finally:
        rows.unpersist()


def _fitted(rows: DataFrame, names: list[str], kind: str) -> float:
    classes = rows.select("y").distinct().count()
    if classes < 2:
        return 1.0
    rows = StringIndexer(inputCol="y", outputCol="label").fit(rows).transform(rows)
    rows = Pipeline(stages=_pipeline(names, kind)).fit(rows).transform(rows)
    if kind == "surrogate-SGD-SVD":
        size = len(rows.select("wide").first()[0])
        if size > 2:  # components of all rows: a combination stands as often as it has rows
            each = rows.select("wide", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
            pca = PCA(k=min(8, size), inputCol="wide", outputCol="components").fit(each)
            vary = [i for i, v in enumerate(pca.explainedVariance) if v > 1e-9] or [0]  # the others are constant
            rows = VectorSlicer(inputCol="components", outputCol="features", indices=vary).transform(pca.transform(rows))
        else:
            rows = rows.withColumnRenamed("wide", "features")
    linear = LogisticRegression(maxIter=30, regParam=1e-4, weightCol="w")
    found = []
    for fold in (1, 2):
        train, test = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        if kind == "surrogate-SVM":
            svm = LinearSVC(maxIter=20, regParam=1e-3, weightCol="w")
            svm = (svm if classes == 2 else OneVsRest(classifier=svm, weightCol="w")).fit(train)
            margins = lambda t, m=svm: m.transform(t).select("label", "w", F.col("rawPrediction").alias("features"))
            out = LogisticRegression(regParam=1e-4, weightCol="w").fit(margins(train)).transform(margins(test))
        else:
            out = linear.fit(train).transform(test)
        p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
        found.append(out.agg(F.sum(F.col("w") * F.ln(F.greatest(p, F.lit(1e-15)))) / F.sum("w")).first()[0])
    return 1 + median(x for x in found if x is not None)


def surrogate_scores(df: DataFrame, pairs: Sequence[tuple[str, str]], kind: str, model: Sequence[str] = ()) -> DataFrame:
    """A row per pair; pairs are few, each is a distributed fit."""
    rows = [(0, a, b, surrogate_score(df, [*model, a], b, kind)) for a, b in pairs]
    return df.sparkSession.createDataFrame(rows, "batch long, FeatureA string, FeatureB string, Score double")
