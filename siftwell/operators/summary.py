"""What becomes of scored pairs: rankings, roll-ups, relevance-redundancy-relation, agreement of rankings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import mean, median

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.pairs import RELATION


def decorated(scores: DataFrame, cardinalities: DataFrame, coverages: DataFrame) -> DataFrame:
    """Names with their cardinality and coverage: f-(cardinality; coverage)."""
    named = cardinalities.join(coverages, "feature").select("feature", F.format_string("%s-(%d; %d)", "feature", "cardinality", F.bround("coverage", 1).cast("int")).alias("name"))
    a, b = (named.select(F.col("feature").alias(f"Feature{s}"), F.col("name").alias(f"name{s}")) for s in "AB")
    return scores.join(a, "FeatureA", "left").join(b, "FeatureB", "left").select(F.coalesce("nameA", "FeatureA").alias("FeatureA"), F.coalesce("nameB", "FeatureB").alias("FeatureB"), "Score")


def singles(scores: DataFrame, label: str, normalise: bool = True) -> DataFrame:
    """Feature, Score: the median score of each feature with the label; normalised to 0..1 for MI-like heuristics."""
    plain = lambda c: F.split_part(F.col(c), F.lit("-"), F.lit(1))
    other = F.when(plain("FeatureA") == label, F.col("FeatureB")).when(plain("FeatureB") == label, F.col("FeatureA"))
    out = scores.select(other.alias("Feature"), "Score").filter(F.col("Feature").isNotNull()).groupBy("Feature").agg(F.median("Score").alias("Score"))
    if not normalise:
        return out
    w = Window.partitionBy()  # a row for each feature
    low, high = F.min("Score").over(w), F.max("Score").over(w)
    return out.select("Feature", ((F.col("Score") - low) / F.nullif(high - low, F.lit(0.0))).alias("Score"))


def singles_aggregated(single: DataFrame) -> DataFrame:
    """Feature, Score: for each element of crossed features the median over the crosses that hold it."""
    crossed = single.filter(F.col("Feature").contains("AND"))
    parts = F.split(F.split_part(F.col("Feature"), F.lit("-"), F.lit(1)), " AND ")
    return crossed.select(F.explode(parts).alias("Feature"), "Score").groupBy("Feature").agg(F.median("Score").alias("Score"))


def transformers_only(single: DataFrame) -> DataFrame:
    return single.filter(F.col("Feature").contains("_tr_"))


def three_mr_parts(scores: DataFrame, label: str) -> DataFrame:
    """part (relevance, relation, redundancy), a, b, score: each part normalised to 0..1.

    relevance: feature with label; relation: the two elements of a crossed feature, with its score for the
    label, either way; redundancy: two plain features.
    """
    crossed = F.col("FeatureA").contains(RELATION)
    element = lambda i: F.split_part(F.col("FeatureA"), F.lit(RELATION), F.lit(i))
    relevance = scores.filter((F.col("FeatureB") == label) & ~crossed & (F.col("FeatureA") != label)).select(F.lit("relevance").alias("part"), F.col("FeatureA").alias("a"), F.lit(label).alias("b"), "Score")
    rel = scores.filter((F.col("FeatureB") == label) & crossed)
    relation = rel.select(F.lit("relation").alias("part"), element(1).alias("a"), element(2).alias("b"), "Score").union(rel.select(F.lit("relation"), element(2), element(1), "Score"))
    plain = scores.filter((F.col("FeatureA") != label) & (F.col("FeatureB") != label) & ~crossed & ~F.col("FeatureB").contains(RELATION))
    redundancy = plain.select(F.lit("redundancy").alias("part"), F.col("FeatureA").alias("a"), F.col("FeatureB").alias("b"), "Score")
    parts = relevance.union(relation).union(redundancy).groupBy("part", "a", "b").agg(F.max("Score").alias("Score"))
    w = Window.partitionBy("part")
    low, high = F.min("Score").over(w), F.max("Score").over(w)
    return parts.select("part", "a", "b", ((F.col("Score") - low) / F.nullif(high - low, F.lit(0.0))).alias("score"))


def three_mr_ranking(parts: DataFrame, strategy: str = "median", alpha: float = 1.0, beta: float = 1.0) -> list[str]:
    """Greedy order of features by relevance - alpha * redundancy + beta * relation to those taken before.

    Works on feature-level numbers, which the driver holds; ties go to the name.
    """
    combine: Callable[[Sequence[float]], float] = {"median": median, "mean": mean, "sum": sum}[strategy]
    rows = parts.collect()
    relevance = {r.a: r.score or 0.0 for r in rows if r.part == "relevance"}
    between = {p: {(r.a, r.b): r.score or 0.0 for r in rows if r.part == p} for p in ("relation", "redundancy")}
    get = lambda p, a, b: between[p].get((a, b), between[p].get((b, a), 0.0))
    ranked: list[str] = []
    while left := sorted(set(relevance) - set(ranked)):
        gain = lambda f: relevance[f] - (alpha * combine([get("redundancy", f, g) for g in ranked]) - beta * combine([get("relation", f, g) for g in ranked]) if ranked else 0.0)
        ranked.append(max(left, key=gain))
    return ranked


def hits_at(rankings: DataFrame, against: str, ks: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """run, k, hits: percent of the top k that a run shares with the run ``against``.  rankings: run, Feature, Score."""
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("Score"), "Feature"))
    placed = rankings.withColumn("place", place)
    best = placed.filter(F.col("run") == against).select("Feature", F.col("place").alias("best"))
    k = placed.join(best, "Feature", "left").withColumn("k", F.explode(F.lit(list(ks)).cast("array<int>"))).filter(F.col("place") <= F.col("k"))
    return k.groupBy("run", "k").agg((F.avg(F.when(F.col("best") <= F.col("k"), 100.0).otherwise(0.0))).alias("hits"))


def rank_statistics(rankings: DataFrame) -> DataFrame:
    """Feature, mean_rank, std_rank over runs; equal scores share their mean rank."""
    w = Window.partitionBy("run").orderBy(F.desc("Score"))
    tied = F.count("*").over(Window.partitionBy("run", "Score"))
    placed = rankings.withColumn("rank", F.rank().over(w) + (tied - 1) / 2)
    return placed.groupBy("Feature").agg(F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("std_rank"))


def overlap_score(a: Sequence[str], b: Sequence[str], p: float = 0.9) -> float:
    """Rank-biased overlap of two rankings, extended to their common depth."""
    depth = min(len(a), len(b))
    if not depth:
        return 0.0
    total = last = 0.0
    for d in range(1, depth + 1):
        last = len(set(a[:d]) & set(b[:d])) / d
        total += p ** (d - 1) * last
    return (1 - p) * total + last * p**depth


def recursive_evolution(rank: Callable[[list[str]], Sequence[str]], start: Sequence[str], rounds: int = 80) -> list[str]:
    """Grows a model: each round ranks candidates with it and adds the best that is not the label (row 2)."""
    model = list(start)
    for _ in range(rounds):
        found = [f for f in rank(model) if f not in model]
        if len(found) < 2:
            break
        model.append(found[1].split("-(")[0])
    return model
