"""Batch statistics of expressions against numpy, with blocks and brackets small enough to be crossed."""

import numpy as np
import pytest

from siftwell.operators import enrich
from siftwell.plans import batchwise


@pytest.fixture
def values():
    rng = np.random.default_rng(5)
    return np.round(rng.normal(size=400) * 3, 1)


def frame(spark, values, batches=2):
    size = max(1, len(values) // batches)
    rows = [(i // size, i % size, i, None if v is None else repr(float(v))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "batch long, pos long, idx long, v string")


def test_calls_of_batches_by_place_and_by_rank(spark, values, monkeypatch):
    monkeypatch.setattr(batchwise, "SMALL", 10)
    monkeypatch.setattr(batchwise, "ACCURACY", 200)
    monkeypatch.setattr(batchwise, "BLOCK", 7)
    monkeypatch.setattr(batchwise, "RANGES", 9)
    forms = {
        "_max": "max(x) OVER {b}",
        "_nested": "max(x - min(x) OVER {b}) OVER {b}",
        "_median": "percentile(x, 0.5D) OVER {b}",
        "_p5": "percentile(pow(x, 2D), 0.05D) OVER {b}",
        "_p99": "percentile(x, 0.99D) OVER {b}",
        "_sum": "sum(x) OVER {bo}",
        "_diff": "x - lag(x, 1, 0D) OVER {bl}",
        "_cdf": "cume_dist(abs(x)) OVER {bx}",
    }
    found = {(r.feature, r.idx): float(r.value) for r in enrich.transform_rows(frame(spark, values), ["v"], forms).collect()}
    for b in (0, 1):
        x = values[b * 200 : b * 200 + 200]
        want = {
            "_max": np.full(200, x.max()),
            "_nested": np.full(200, (x - x.min()).max()),
            "_median": np.full(200, np.quantile(x, 0.5)),
            "_p5": np.full(200, np.quantile(x**2, 0.05)),
            "_p99": np.full(200, np.quantile(x, 0.99)),
            "_sum": np.cumsum(x),
            "_diff": np.diff(x, prepend=0.0),
            "_cdf": np.array([(np.abs(x) <= abs(v)).mean() for v in x]),
        }
        for name, w in want.items():
            got = np.array([found["v" + name, b * 200 + i] for i in range(200)])
            assert np.allclose(got, w, atol=1e-9), name


def test_profile_equals_rows(spark, values):
    forms = {"_sqrt": "sqrt(x)", "_log": "IF(x > 0D, ln(x), double('-Infinity'))", "_sum": "sum(x) OVER {bo}", "_median": "percentile(x, 0.5D) OVER {b}"}
    df = frame(spark, [*values[:50], None])
    rows = enrich.transform_rows(df, ["v"], forms).collect()
    for r in enrich.transform_profile(df, ["v"], forms).collect():
        own = [float(x.value) for x in rows if x.feature == r.feature and x.value is not None]
        fine = [v for v in own if np.isfinite(v)]
        assert (r.rows, r.finite) == (51, len(fine)) and r.low == min(fine)


def test_empty_frame(spark):
    df = frame(spark, [1.0]).filter("idx < 0")
    assert enrich.transform_profile(df, ["v"], {"_m": "percentile(x, 0.5D) OVER {b}"}).count() == 0
