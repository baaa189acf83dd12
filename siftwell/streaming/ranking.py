"""Ranking a stream: each micro-batch is a mini-batch, the ranking so far is the median over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.heuristics import scores
from siftwell.operators.pairs import median_scores
from siftwell.plans.frame import TAIL, categorical


def _is_there(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def rank_stream(stream: DataFrame, features: Sequence[str], order: Sequence[str], pairs: Sequence[tuple[str, str]], out: str, checkpoint: str, heuristic: str = "MI-numba-randomized", least: int = TAIL) -> StreamingQuery:
    """Starts a query that writes to ``out`` the scores of the rows so far unscored, once there are more than ``least``.

    Rows of smaller micro-batches wait in ``<out>_waiting`` for the next; what waits when the stream ends is the tail.
    A batch overwrites its own folders and reads those of the batch before, so one that runs again after a failure
    counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, waiting = batch.sparkSession, f"{out}_waiting/batch="
        before = f"{waiting}{number - 1}"
        if _is_there(spark, before):
            batch = spark.read.schema(batch.schema).parquet(before).union(batch)
        rows = categorical(batch, features, order)
        enough = rows.count() > least
        if enough:
            found = scores(rows, pairs, heuristic).select("FeatureA", "FeatureB", "Score")
            found.write.mode("overwrite").parquet(f"{out}/micro_batch={number}")
        (batch.limit(0) if enough else batch).write.mode("overwrite").parquet(f"{waiting}{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ranking_so_far(spark, out: str) -> DataFrame:
    return median_scores(spark.read.parquet(out)).orderBy(F.desc("Score"))


def running_cardinality(stream: DataFrame, column: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Distinct values per event-time window, by mergeable sketches; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.approx_count_distinct(column).alias("values"), F.count("*").alias("rows"))
