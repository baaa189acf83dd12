"""Golden values and needles for the screening operators."""

import datetime
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell import catalogue
from siftwell.functions import transforms
from siftwell.operators import enrich, pairs, profile, row_quality, sketches, summary, surrogates, synth
from siftwell.operators.heuristics import scores
from siftwell.plans.frame import categorical, with_batches, with_index
from siftwell.sources import readers

A, MEDIUM, HIGH = (1, 0, 0, 0, 1, 1, 1, 0), (1, 1, 0, 0, 1, 1, 1, 1), (1, 0, 0, 0, 1, 1, 1, 1)


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(zip(A, MEDIUM, HIGH, strict=True))], "i int, a int, medium int, high int")
    return categorical(df, ["a", "medium", "high"], ["i"])


def found(df):
    return {(r.FeatureA, r.FeatureB): r.Score for r in df.collect()}


def test_mutual_information_of_known_vectors(vectors):
    plain = found(scores(vectors, [("a", "a"), ("a", "medium"), ("a", "high")], "MI"))
    assert plain["a", "a"] == pytest.approx(0.693147, abs=1e-6)
    assert plain["a", "medium"] == pytest.approx(0.215762, abs=1e-6)
    assert plain["a", "high"] == pytest.approx(0.380396, abs=1e-6)


def test_noise_corrected_information(vectors):
    got = found(scores(vectors, [("a", "medium"), ("a", "high"), ("a", "a")], "MI-numba-randomized"))
    assert got["a", "medium"] == pytest.approx(0.042475, abs=1e-6)
    assert got["a", "high"] == pytest.approx(0.107881, abs=1e-6)
    assert got["a", "a"] == pytest.approx(0.693147, abs=1e-6)  # equal codes: no background


def test_coverage_heuristic(spark):
    df = categorical(spark.createDataFrame([(i, i + 1, i + 6, 3) for i in range(5)], "i int, a int, b int, c int"), ["a", "b", "c"], ["i"])
    got = found(scores(df, [("a", "b"), ("c", "c")], "max-value-coverage"))
    assert got["a", "b"] == pytest.approx(0.2) and got["c", "c"] == 1.0


def test_adjusted_information_is_one_for_equal_columns(vectors):
    assert found(scores(vectors, [("a", "a")], "AMI"))["a", "a"] == pytest.approx(1.0, abs=1e-9)


def test_adjusted_information_of_all_orders_by_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice("ABC"), rng.choice("FOP"), datetime.date(1992 + rng.randrange(3), rng.randrange(1, 13), 1), rng.randrange(200)) for i in range(73)]
    rows = [(i, p, "F" if p == "A" else s, d, c) for i, p, s, d, c in rows]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderstatus string, o_orderdate date, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))

    def brute(y, x):
        n, xs, ys = len(x), Counter(x), Counter(y)
        term = lambda k, a, b: k / n * math.log(n * k / (a * b))
        mi = sum(term(k, xs[u], ys[v]) for (u, v), k in Counter(zip(x, y, strict=True)).items())
        e = sum(term(k, a, b) * math.comb(b, k) * math.comb(n - b, a - k) / math.comb(n, a) for a in xs.values() for b in ys.values() for k in range(max(1, a + b - n), min(a, b) + 1))
        h = [-sum(c / n * math.log(c / n) for c in z.values()) for z in (xs, ys)]
        return (mi - e) / (sum(h) / 2 - e)

    status = [r[2] for r in rows]
    want = {"o_orderpriority": [r[1] for r in rows], "o_year": [r[3].year for r in rows], "o_month": [r[3].month for r in rows], "cust50": [r[4] % 50 for r in rows]}
    got = found(catalogue.QUERIES["rank_ami"](spark, str(tmp_path)))
    assert set(got) == {(f, "o_orderstatus") for f in want}
    for f, y in want.items():
        assert got[f, "o_orderstatus"] == pytest.approx(brute(y, status), abs=2e-6), f


def test_unknown_heuristic(vectors):
    with pytest.raises(ValueError):
        scores(vectors, [("a", "a")], "none")


def test_pairs():
    assert set(pairs.label_pairs(["a", "b", "label"], "label")) == {("a", "label"), ("b", "label"), ("label", "label")}
    assert len(pairs.all_pairs(["a", "b", "label"], "label")) == 8
    sampler = pairs.PairSampler(2)
    assert sampler.take([("a",), ("b",), ("c",)]) == [("a",), ("b",)] and sampler.take([("a",), ("b",), ("c",)]) == [("c",), ("a",)]


def test_index_and_tail(spark):
    df = with_index(spark.range(2500).select((F.col("id") * 7).alias("k")), ["k"])
    assert [r.idx for r in df.orderBy("k").limit(3).collect()] == [0, 1, 2]
    assert df.agg(F.max("idx"), F.count_distinct("idx")).first()[:] == (2499, 2500)
    assert with_batches(df, 1000).count() == 2000 and with_batches(df, 1000, 400).count() == 2500


def test_presets_and_forms(spark):
    assert {k: len(v) for k, v in transforms.PRESETS.items() if k != "verbose"} == {"minimal": 4, "default": 10, "extended": 27, "extended_rounded": 108, "fw-transformers": 138}
    x = spark.createDataFrame([(1.0,), (2.0,), (5.0,)], "x double")
    form = transforms.PRESETS["fw-transformers"]["_tr_fw_sqrt_res_1_gt_1"]
    assert [r[0] for r in x.selectExpr(form).collect()] == [0.0, 1.0, 2.0]
    with pytest.raises(NotImplementedError):
        transforms.load("")
    with pytest.raises(NameError):
        transforms.parse("X + y")
    with pytest.raises(SyntaxError):
        transforms.parse("X +")
    got = spark.createDataFrame([(4.0,)], "x double").selectExpr(transforms.parse("np.sqrt(X) + 1 / X")).first()[0]
    assert got == pytest.approx(2.25)


def test_transform_rows_and_admission(spark):
    df = categorical(spark.createDataFrame([(i, float(v)) for i, v in enumerate((1, 4, 9, 16))], "i int, f double"), ["f"], ["i"])
    rows = enrich.transform_rows(df, ["f"], transforms.PRESETS["minimal"])
    assert [r.value for r in rows.filter(F.col("feature") == "f_tr_sqrt").orderBy("idx").collect()] == ["1.0", "2.0", "3.0", "4.0"]
    assert enrich.admitted(rows).count() == 4
    placed = {(r.feature, r.idx): r.value for r in enrich.place_rows(df, "f").collect()}
    assert [placed["f_tr_reverse", i] for i in range(4)] == ["16.0", "9.0", "4.0", "1.0"] and placed["f_tr_cumulative_prod", 2] == "36.0"
    assert placed["f_tr_sort_squared", 3] == "256.0" and len(transforms.PRESETS["verbose"]) + len(transforms.BY_PLACE) == 232


def test_crosses(spark):
    df = categorical(spark.createDataFrame([(0, 1, 2, 3), (1, 3, 2, 1), (2, 1, 1, 1), (3, 2, 3, 4)], "i int, F1 int, F2 int, F3 int"), ["F1", "F2", "F3"], ["i"])
    assert len(enrich.with_crosses(df, ["F1", "F2", "F3"], 3)[1]) == 1 and len(enrich.with_crosses(df, ["F1", "F2", "F3"], 2)[1]) == 3


def test_entropy_and_rows(spark):
    df = spark.createDataFrame([("hello",), ("",), (None,), ("aaaa",)], "s string")
    got = [r[0] for r in df.select(row_quality.entropy(F.col("s"))).collect()]
    assert got == [pytest.approx(1.92193, abs=1e-5), 0.0, 0.0, 0.0]


def test_sketches(spark):
    df = spark.range(3000).select((F.col("id") % 500).alias("v"), F.lit(-1).alias("d"))
    m = sketches.count_min(df, "v")
    assert sketches.count_min_query(m, df, "v").filter("estimate < 6").count() == 0
    none = sketches.count_min_query(sketches.merge(m, sketches.count_min(df, "v", "d")), df, "v")
    assert none.filter("estimate <> 0").count() == 0
    assert sketches.distinct_estimate(df, "v").first().estimate == 500


def test_bounded_counts_stop(spark):
    df = categorical(spark.createDataFrame([(i, v) for i, v in enumerate("aabcabd")], "i int, f string"), ["f"], ["i"])
    assert {r.value: r.n for r in profile.bounded_counts(df, ["f"], 3).collect()} == {"a": 2, "b": 1, "c": 1}


def test_needle_is_found(spark):
    df = synth.benchmark(spark, 4000, 55, 2, seed=1)
    rows = categorical(df, ["f30", "f50", "f1", "f2", "label"], ["idx"])
    rows, names = enrich.with_crosses(rows, ["f30", "f50", "f1", "f2"], 2, "label")
    got = found(scores(rows, [(n, "label") for n in names], "MI-numba-randomized"))
    assert max(got, key=got.get)[0] == "f30 AND f50"


def test_three_mr_prefers_relevant_and_new():
    class Row:
        def __init__(self, part, a, b, score):
            self.part, self.a, self.b, self.score = part, a, b, score

    rows = [Row("relevance", "x", "l", 1.0), Row("relevance", "y", "l", 0.9), Row("relevance", "z", "l", 0.5), Row("redundancy", "x", "y", 1.0), Row("redundancy", "x", "z", 0.0)]
    order = summary.three_mr_ranking(type("D", (), {"collect": lambda self: rows})())
    assert order == ["x", "z", "y"]


def test_synthetic_data(spark):
    df = synth.categorical(spark, 500, 3, 5, ensure=True)
    assert df.agg(F.count_distinct("f0")).first()[0] == 5
    both = synth.correlated(synth.uniform_matrix(spark, 2000, 1), "f0", "g", 0.8)
    assert both.agg(F.corr("f0", "g")).first()[0] == pytest.approx(0.8, abs=1e-6)
    with pytest.raises(ValueError):
        synth.with_noise(df, ["f0"], "nothing")


def test_readers(spark, tmp_path):
    (tmp_path / "data.csv").write_text('f1,"f2,quoted",f3\n1,a,x\n2,,y\n')
    data = readers.read(spark, "csv-raw", str(tmp_path))
    assert data.columns == ["f1", "f2,quoted", "f3"] and [r[1] for r in data.rows.orderBy("f1").collect()] == ["a", ""]
    (tmp_path / "dataset_desc.json").write_text(json.dumps({"data_features": [{"name": "a", "type": "Float32"}, {"name": "b", "type": "str"}, {"name": "c", "type": "str"}]}))
    assert readers.read(spark, "ob-csv", str(tmp_path)).numeric == {"a"}
    (tmp_path / "vw_namespace_map.csv").write_text("aa,f1,f32\nbb,f2\nbroken\n")
    (tmp_path / "data.vw").write_text("skipped\n1 |aa 1:5 1:6 |bb x:7\n-1 |bb y:8\n")
    rows = readers.read(spark, "ob-vw", str(tmp_path)).rows.collect()
    assert [tuple(r) for r in rows] == [("1", "5-1:6", "7"), ("-1", None, "8")]
    with pytest.raises(NotImplementedError):
        readers.read(spark, "nothing", str(tmp_path))


def test_rank_statistics(spark):
    runs = spark.createDataFrame([("r", "a", 3.0), ("r", "b", 2.0), ("s", "a", 1.0), ("s", "b", 2.0)], "run string, Feature string, Score double")
    got = {r.Feature: (r.mean_rank, r.std_rank) for r in summary.rank_statistics(runs).collect()}
    assert got["a"] == (1.5, pytest.approx(math.sqrt(0.5)))
    assert {(r.run, r.k): r.hits for r in summary.hits_at(runs, "r", (1, 2)).collect()} == {("r", 1): 100.0, ("r", 2): 100.0, ("s", 1): 0.0, ("s", 2): 100.0}


def test_surrogates_tell_a_twin_from_noise(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(i, y := rng.choice("abc"), y if rng.random() < 0.9 else "a", str(rng.randrange(3))) for i in range(120)]
    df = categorical(spark.createDataFrame(rows, "i int, y string, twin string, noise string"), ["y", "twin", "noise"], ["i"])
    two = df.filter("y <> 'c'")
    score = lambda c, kind: surrogates.surrogate_score(two if kind == "surrogate-SVM" else df, [c], "y", kind)
    noise = score("noise", "surrogate-SGD")
    for kind in ("surrogate-SVM", "surrogate-SGD-SVD", "surrogate-SGD-RP", "surrogate-SGD"):
        assert (got := score("twin", kind)) > noise + 0.3, (kind, got, noise)
    with pytest.raises(ValueError):
        surrogates.surrogate_score(df, ["twin"], "y", "surrogate-none")


def test_halves_of_each_label(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "BLOCK", 8)
    rows = [(i, "a" if i % 3 else "b") for i in range(101)]
    got = surrogates._halves(spark.createDataFrame(rows, "idx long, y string")).collect()
    for y in "ab":
        own = [i for i, x in rows if x == y]
        assert sorted(r.idx for r in got if r.y == y and r.fold == 1) == own[: (len(own) + 1) // 2]
    assert len(got) == 101
