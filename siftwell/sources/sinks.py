"""Writers of results, through Spark's file systems: a folder per table, small JSON as one line of text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str) -> None:
    """One file, in the order of df; for tables of features, which are small."""
    df.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_ranks(scores: DataFrame, folder: str) -> None:
    write_tsv(scores.orderBy("Score", "FeatureA", "FeatureB"), f"{folder}/pairwise_ranks.tsv")


def write_singles(single: DataFrame, heuristic: str, folder: str, aggregated: DataFrame | None = None, transformers: DataFrame | None = None) -> None:
    named = lambda t: t.orderBy(F.desc("Score"), "Feature").withColumnRenamed("Score", f"Score {heuristic}")
    write_tsv(named(single), f"{folder}/feature_singles.tsv")
    if aggregated is not None:
        write_tsv(named(aggregated), f"{folder}/feature_singles_aggregated.tsv")
    if transformers is not None:
        write_tsv(named(transformers), f"{folder}/feature_singles_transformers_only_imp.tsv")


def write_json(spark: SparkSession, value, path: str) -> None:
    text = value if isinstance(value, str) else json.dumps(value)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_profile(tables: dict[str, DataFrame], folder: str) -> None:
    """memory, numeric_feature_statistics, rare_values, feature_sparsity_summary and the like."""
    for name, t in tables.items():
        write_tsv(t, f"{folder}/{name}.tsv")


def write_data(df: DataFrame, path: str) -> None:
    """Synthetic data as CSV parts with headers; distributed."""
    df.write.mode("overwrite").csv(path, header=True)
