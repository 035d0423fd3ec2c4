"""Learners from sums: equal to refitting, fold by fold and flip by flip."""
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loupe.operators import additive as S
from loupe.operators import classifiers as A
from loupe.operators import dark as N
from loupe.operators.scalers import fit_scaler
from loupe.plans import registry
from loupe.plans.queries_model import EMB_LABELS, emb_frame
from loupe.plans.spotcheck import Candidate, Sampling, cross_val_score, fold_sums

K = 3


@pytest.fixture(scope="module")
def frame(spark):
    """Three classes, one with over half of the rows, and one feature far from zero."""
    rng = np.random.default_rng(5)
    y = rng.choice(3, 240, p=[0.55, 0.25, 0.2])
    X = rng.normal(size=(240, 4)) * [1.0, 2.0, 0.5, 3.0] + y[:, None] * [0.8, 0.0, 0.4, -1.0] + [0.0, 5.0, 0.0, 730000.0]
    X[:, 2] = np.abs(X[:, 2])
    rows = [(i, float(y[i]), i % 4, X[i].tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label_idx double, fold int, x array<double>")
    return df.withColumn("features", array_to_vector("x")).drop("x").cache()


@pytest.mark.parametrize("code", S.ALGORITHMS)
@pytest.mark.parametrize("scaler", S.SCALERS)
def test_out_of_fold_predictions_equal_refits(frame, code, scaler):
    if code in ("MNB", "CNB") and scaler == "STA":
        pytest.skip("one scaled learner on counts is enough")
    df = frame
    if code in ("MNB", "CNB"):
        df = frame.withColumn("features", array_to_vector(F.transform(F.split(F.lit("0,1,2,3"), ","), lambda i: F.pmod(
            F.hash(F.col("id"), i), F.lit(9)).cast("double") + F.col("label_idx"))))
    got = {r["id"]: r for r in S.out_of_fold(S.PartSums(df, K, "fold"), code, scaler).collect()}
    assert len(got) == 240
    for f in range(4):
        train, test = df.filter(F.col("fold") != f), df.filter(F.col("fold") == f)
        s = fit_scaler(scaler, train)
        for r in A.fit(code, s.transform(train), K).transform(s.transform(test)).collect():
            assert got[r["id"]]["prediction"] == r["prediction"]
            if r["probability"] is None:
                assert got[r["id"]]["probability"] is None
            else:
                assert np.allclose(got[r["id"]]["probability"], r["probability"], rtol=1e-4, atol=1e-7)


@pytest.mark.parametrize("metric", ["accuracy", "f1_macro"])
def test_fold_scores_equal_refits(frame, metric):
    sums = fold_sums(frame, K)
    labels = ["a", "b", "c"]
    for c in (Candidate("STA", "NOR", "GNB"), Candidate("NOS", "NOR", "LDA")):
        want = cross_val_score(frame, K, labels, c, 4, metric, "id")
        assert np.allclose(cross_val_score(frame, K, labels, c, 4, metric, "id", Sampling(), sums), want)


def test_rows_leave_and_join_a_class():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(50, 3)) + 1e6

    def of(Z):
        return len(Z), Z.mean(axis=0), ((Z - Z.mean(axis=0)) ** 2).sum(axis=0)
    s = S.Sums.empty(2, 3)
    s.add(0, *of(X[:30]))
    s.add(0, *of(X[30:]))
    s.remove(0, *of(X[:10]))
    s.add(1, *of(X[:10]))
    for c, Z in ((0, X[10:]), (1, X[:10])):
        n, mean, m2 = of(Z)
        assert s.n[c] == n and np.allclose(s.mean[c], mean, rtol=1e-12) and np.allclose(s.m2[c], m2, rtol=1e-4)
    s.remove(1, *of(X[:10]))
    assert s.n[1] == 0 and not s.m2[1].any()
    assert S.closed_form("NCT", s)[0][1] == -math.inf


@pytest.mark.parametrize("code,mode", [("GNB", "predict"), ("GNB", "predict_proba"), ("LDA", "predict"), ("NCT", "predict")])
def test_correction_factors_equal_refits(frame, code, mode):
    got = N.correction_factors(frame, code, K, n_splits=3, n_repeats=1, predict_mode=mode, key="id")
    for c in range(K):
        want = N.correction_factor(frame, code, K, c, n_splits=3, n_repeats=1, predict_mode=mode, key="id")
        assert got[c]["n_rows"] == want["n_rows"] == 240 and got[c]["skipped"] == want["skipped"] is False
        assert np.allclose(got[c]["shares"], want["shares"], rtol=1e-4, atol=1e-6)
        assert got[c]["factor"] == pytest.approx(want["factor"], rel=1e-4)


def test_correction_factors_of_small_missing_and_empty_classes(frame, spark):
    got = N.correction_factors(frame.filter("label_idx < 2"), "GNB", K, n_splits=3, n_repeats=1, key="id")
    assert got[2]["skipped"] and got[2]["factor"] == 1.0 and got[2]["min_rows"] is None
    assert not got[0]["skipped"]
    few = N.correction_factors(frame.limit(12), "GNB", K, key="id")
    assert all(r["skipped"] and r["factor"] == 1.0 for r in few.values())
    none = N.correction_factors(frame.filter("id < 0"), "GNB", K, key="id")
    assert [none[c]["n_rows"] for c in range(K)] == [0, 0, 0]


def test_extrapolations():
    exact = N.extrapolations([(0.5, 2.0), (0.75, 3.0), (0.9, 3.6)])
    assert exact["linear"] == pytest.approx(4.0) and exact["poly2"] == pytest.approx(4.0)
    two = N.extrapolations([(0.5, 1.0), (0.9, 0.5), (0.75, math.inf)])
    assert two["poly2"] is None and two["linear"] == pytest.approx(0.375) and two["logbounded"] == 1.0
    assert set(N.extrapolations([(0.5, 2.0)]).values()) == {None}


def test_registered_factor_queries(spark, sf):
    registry.load_all()
    n = emb_frame(spark, sf).count()
    for name in ("N10_correction_factors", "N11_correction_factors_probability"):
        rows = registry.QUERIES[name](spark, sf).collect()
        assert sorted(r["label"] for r in rows) == sorted(EMB_LABELS) and {r["n_rows"] for r in rows} == {n}
        assert all(r["factor"] >= 1 for r in rows)
    rows = registry.QUERIES["N10_N13_correction_factor"](spark, sf).collect()
    assert len(rows) == len(EMB_LABELS) * 7


@pytest.mark.parametrize("code,scaler", [("LDA", "STA"), ("GNB", "MIX"), ("NCT", "NOS")])
def test_saved_learners_score_as_before(frame, spark, tmp_path, code, scaler):
    from loupe.sources.models import load_closed_form, save_closed_form
    m = S.fit_closed_form(code, frame, K, scaler)
    save_closed_form(spark, str(tmp_path), "learner", m)
    again = load_closed_form(spark, str(tmp_path), "learner")
    assert again.algorithm == code and again.has_probability == m.has_probability
    s = fit_scaler(scaler, frame)
    want = {r["id"]: r for r in A.fit(code, s.transform(frame), K).transform(s.transform(frame)).collect()}
    rows = again.transform(frame).collect()
    assert len(rows) == 240 and all(r["prediction"] == want[r["id"]]["prediction"] for r in rows)
    assert set(frame.columns) < set(again.transform(frame).columns)


def test_a_table_without_a_learner_is_an_error(spark, tmp_path):
    from loupe.sources.models import STATE, load_closed_form
    spark.createDataFrame([("GNB", "b", [1], [0.0])], STATE).write.parquet(str(tmp_path / "half"))
    with pytest.raises(ValueError, match="holds no learner"):
        load_closed_form(spark, str(tmp_path), "half")


def test_factors_of_a_prepared_table_are_finite(spark, sf):
    from loupe.plans.flagship import correction_factors
    from loupe.plans.prepare import Prepared
    got = correction_factors(Prepared(emb_frame(spark, sf), EMB_LABELS, 5, "vec_id"), "GNB", n_repeats=1, n_splits=3)
    assert list(got) == EMB_LABELS and all(math.isfinite(v) and v >= 1 for v in got.values())
