"""The corpus pipeline: toxicity, near-duplicates, personal data, mixture, packing.

``run`` chains the stages on ``documents``; a runner may as well write each stage's result and read it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_duplicates),
    ("pii", stages.redact_personal_data),
    ("mixing", stages.mix),
    ("packing", stages.pack_documents),
]

#: Classifiers, near-duplicate components and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.llm.shared import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
