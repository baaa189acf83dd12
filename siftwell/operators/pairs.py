"""Which pairs of features are scored, and what becomes of their scores."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELATION = " AND_REL "


def label_pairs(features: Sequence[str], label: str) -> list[tuple[str, str]]:
    """Each feature, the label among them, with the label."""
    return [(f, label) for f in features if f != label] + [(label, label)]


def all_pairs(features: Sequence[str], label: str) -> list[tuple[str, str]]:
    """The upper triangle with the diagonal, and once more the diagonal of each feature but the label."""
    return [*combinations_with_replacement(features, 2), *((f, f) for f in features if f != label)]


def relation_pairs(features: Sequence[str], label: str) -> list[tuple[str, str]]:
    """The triangle of plain features in name order, and each relation feature with the label."""
    plain = sorted(f for f in features if RELATION not in f)
    return [*combinations_with_replacement(plain, 2), *((f, label) for f in features if RELATION in f)]


class PairSampler:
    """Takes the pairs used least so far, first listed first, up to a bound; counts survive between calls."""

    def __init__(self, bound: int = 2**15):
        self.bound, self.uses = bound, Counter()

    def take(self, pairs: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
        chosen = sorted(pairs, key=lambda p: self.uses[p])[: self.bound]
        self.uses.update(chosen)
        return chosen

    def to_json(self) -> str:
        return json.dumps({str(p): n for p, n in self.uses.items()})


def outside_model(pairs: Sequence[tuple[str, str]], known: set[str]) -> list[tuple[str, str]]:
    """Pairs that touch no feature of a reference model."""
    return [p for p in pairs if not known & set(p)]


def crosses(features: Sequence[str], order: int, label: str) -> list[tuple[str, ...]]:
    return list(combinations([f for f in features if f != label], order))


def both_ways(scores: DataFrame) -> DataFrame:
    """Each triplet also with its features swapped."""
    return scores.select("FeatureA", "FeatureB", "Score").union(scores.select("FeatureB", "FeatureA", "Score"))


def median_scores(scores: DataFrame) -> DataFrame:
    """The median of a pair's scores over batches."""
    return scores.groupBy("FeatureA", "FeatureB").agg(F.median("Score").alias("Score"))
