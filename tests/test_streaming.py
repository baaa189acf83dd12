"""Ranking by micro-batches: small ones wait for the next, none is lost."""

import pytest

from siftwell.operators.heuristics import scores
from siftwell.plans.frame import categorical
from siftwell.streaming.ranking import rank_stream, ranking_so_far


def test_small_micro_batches_wait(spark, tmp_path):
    rows = [(i, str(i % 3), str(i % 3 if i % 7 else 0)) for i in range(60)]
    schema = "i long, a string, y string"
    for n in range(6):  # six files of ten rows, one a micro-batch
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], schema).coalesce(1).write.parquet(str(tmp_path / f"in/f{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = str(tmp_path / "out")
    rank_stream(stream, ["a", "y"], ["i"], [("a", "y")], out, str(tmp_path / "state"), "MI", least=59).awaitTermination()
    whole = scores(categorical(spark.createDataFrame(rows, schema), ["a", "y"], ["i"]), [("a", "y")], "MI").first().Score
    got = ranking_so_far(spark, out).collect()
    assert len(got) == 1 and got[0].Score == pytest.approx(whole)
