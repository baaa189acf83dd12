"""The data behind plots of scored pairs: similarity matrix, clusters of features, top features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features that a matrix on the driver may have.
MOST = 1000


def pivoted(scores: DataFrame) -> DataFrame:
    """FeatureA and a column per FeatureB: mean scores, 0 where there is none."""
    return scores.groupBy("FeatureA").pivot("FeatureB").avg("Score").fillna(0.0)


def heatmap(scores: DataFrame) -> DataFrame:
    """FeatureA, FeatureB, Score of the lower triangle."""
    return scores.filter(F.col("FeatureA") > F.col("FeatureB")).groupBy("FeatureA", "FeatureB").agg(F.avg("Score").alias("Score"))


def top_features(scores: DataFrame, label: str, k: int | None = None, known: Sequence[str] = ()) -> DataFrame:
    """Feature, Score, known of the k best by median score with the label."""
    near = scores.filter(F.col("FeatureB").contains(label)).groupBy(F.col("FeatureA").alias("Feature")).agg(F.median("Score").alias("Score"))
    out = near.withColumn("known", F.split_part(F.col("Feature"), F.lit("-("), F.lit(1)).isin(*known) if known else F.lit(False)).orderBy(F.desc("Score"), "Feature")
    return out.limit(k) if k else out


def matrix(scores: DataFrame) -> tuple[list[str], np.ndarray]:
    wide = pivoted(scores)
    if len(wide.columns) > MOST + 1:
        raise ValueError(f"more than {MOST} features")
    rows = sorted(wide.collect(), key=lambda r: r[0])
    return [r[0] for r in rows], np.array([[float(x) for x in r[1:]] for r in rows])


def _linkage(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Complete linkage: merges in order, new clusters numbered on."""
    n = len(d)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    name, merges = list(range(n)), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        at = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = np.unravel_index(at.argmin(), at.shape)
        merges.append((name[i], name[j], float(at[i, j])))
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        alive[j] = False
        name[i] = n + step
    return merges


def _cut(n: int, merges, threshold: float) -> np.ndarray:
    parent = list(range(2 * n))
    for step, (a, b, h) in enumerate(merges):
        if h <= threshold:
            parent[a] = parent[b] = n + step

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    out = []
    for i in range(len(d)):
        same = label == label[i]
        if same.sum() < 2:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, label == c].mean() for c in np.unique(label) if c != label[i])
        out.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(out))


def clustered(scores: DataFrame, thresholds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(profile: threshold, clusters, silhouette; best: Feature, cluster) of features by rows of the matrix."""
    spark = scores.sparkSession
    names, m = matrix(scores)
    rows = 1 - m
    d = np.sqrt(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(-1))
    merges = _linkage(d) if len(names) > 1 else []
    top = max([h for *_, h in merges], default=0.0)
    profile, best = [], (-2.0, np.zeros(len(names), int))
    seen: dict[int, float] = {}
    for t in np.linspace(0, top, thresholds):
        label = _cut(len(names), merges, t)
        k = int(label.max(initial=0)) + 1
        if 3 <= k < min(100, len(names)):
            if k not in seen:
                seen[k] = silhouette(d, label)
                if seen[k] > best[0]:
                    best = seen[k], label
            profile.append((float(t), k, seen[k]))
    return spark.createDataFrame(profile, "threshold double, clusters int, silhouette double"), spark.createDataFrame([(n, int(c)) for n, c in zip(names, best[1], strict=True)], "Feature string, cluster int")


def projected(scores: DataFrame) -> DataFrame:
    """Feature, x, y: the two leading components of the matrix."""
    names, m = matrix(scores)
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    xy = np.zeros((len(names), 2))
    xy[:, : min(2, len(s))] = (u * s)[:, :2]
    return scores.sparkSession.createDataFrame([(n, float(a), float(b)) for n, (a, b) in zip(names, xy, strict=True)], "Feature string, x double, y double")
