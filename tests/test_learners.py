"""Invariants and brute-force checks for the operators without a SQL twin."""
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loupe.operators import classifiers as A
from loupe.operators import dark as N
from loupe.operators import resample as R
from loupe.operators.knn import knn_join
from loupe.operators.reduce import fit_reduction
from loupe.plans.queries_model import EMB_LABELS, emb_frame
from loupe.plans.spotcheck import Candidate, Result, improves, pick_best, stable

K = len(EMB_LABELS)


@pytest.fixture(scope="module")
def frame(spark, sf):
    return emb_frame(spark, sf).cache()


def _points(spark, n=300, d=4, seed=3, dup=100):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    X[:dup] = X[0]  # a third of the rows on one point: the skewed case
    rows = [(i, X[i].tolist()) for i in range(n)]
    return X, spark.createDataFrame(rows, "id long, x array<double>")


def test_knn_join_exact_against_brute_force(spark):
    X, df = _points(spark)
    got = knn_join(df, df, 5, exclude_self=True).collect()
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    by_left = {}
    for r in got:
        by_left.setdefault(r["left_id"], []).append(r["dist"])
    assert len(by_left) == len(X)
    for i, ds in by_left.items():
        want = np.sort(D[i])[:5]
        assert np.allclose(sorted(ds), want), i


def test_probabilities_sum_to_one_and_keys_kept(frame):
    train, test = frame.filter("split = 'train'"), frame.filter("split = 'test'")
    for code in ("DUMY", "GNB", "NCT", "LDA", "MNB"):
        tr, te = train, test
        if code == "MNB":
            from loupe.operators.scalers import fit_scaler
            s = fit_scaler("MIX", train)
            tr, te = s.transform(train), s.transform(test)
        m = A.fit(code, tr, K)
        rows = m.transform(te).select("vec_id", "prediction", "probability").collect()
        assert {r["vec_id"] for r in rows} == {r["vec_id"] for r in test.select("vec_id").collect()}
        if not m.has_probability:  # nearest centroid has none: the rate falls back later
            assert all(r["probability"] is None for r in rows)
            continue
        for r in rows:
            assert abs(sum(r["probability"]) - 1.0) < 1e-6
            assert int(r["prediction"]) == int(np.argmax(r["probability"]))


def test_count_nb_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.integers(0, 5, size=(60, 6)).astype(float)
    y = rng.integers(0, 3, size=60).astype(float)
    df = spark.createDataFrame([(X[i].tolist(), float(y[i])) for i in range(60)], "x array<double>, label_idx double") \
        .select(array_to_vector("x").alias("features"), "label_idx")
    got = np.array([r["prediction"] for r in A.fit("MNB", df, 3).transform(df).select("prediction").collect()])
    S = np.stack([X[y == c].sum(0) for c in range(3)])
    W = np.log((S + 1) / (S.sum(1, keepdims=True) + 6))
    b = np.log(np.bincount(y.astype(int), minlength=3) / 60)
    assert (got == np.argmax(X @ W.T + b, axis=1)).all()
    comp = S.sum(0, keepdims=True) - S + 1
    Wc = -np.log(comp / comp.sum(1, keepdims=True))
    got_c = np.array([r["prediction"] for r in A.fit("CNB", df, 3).transform(df).select("prediction").collect()])
    assert (got_c == np.argmax(X @ Wc.T, axis=1)).all()


def test_resampled_class_counts(frame):
    train = frame.filter("split = 'train'").select("vec_id", "label_idx", "features")
    sizes = R.class_sizes(train)
    n_min, n_max = min(sizes.values()), max(sizes.values())
    under = R.class_sizes(R.undersample("RND", train, key="vec_id"))
    assert set(under.values()) == {n_min}
    over = R.class_sizes(R.oversample("RND", train, key="vec_id"))
    assert set(over.values()) == {n_max}
    sm = R.class_sizes(R.oversample("SME", train, key="vec_id"))
    assert set(sm.values()) == {n_max}
    cc = R.class_sizes(R.undersample("CCS", train, key="vec_id"))
    assert max(cc.values()) <= n_min


def test_cleaning_undersamplers_only_remove_rows(frame):
    train = frame.filter("split = 'train'").select("vec_id", "label_idx", "features")
    n = train.count()
    for code in ("ENN", "TKL", "NMS"):
        assert R.undersample(code, train, key="vec_id").count() <= n


def test_reductions_shapes(frame):
    train = frame.filter("split = 'train'")
    for code in ("PCA", "GRP", "TSVD"):
        red = fit_reduction(code, train, K)
        from pyspark.ml.functions import vector_to_array
        sizes = {r["s"] for r in red.transform(train).select(F.size(vector_to_array("features")).alias("s")).collect()}
        assert red.components and red.components > 0
        assert sizes == {red.components}


def test_models_beat_dummy(frame):
    from loupe.operators import metrics as M
    train, test = frame.filter("split = 'train'"), frame.filter("split = 'test'")
    base = M.score_value(A.fit("DUMY", train, K).transform(test), EMB_LABELS, "accuracy")
    best = max(M.score_value(A.fit(c, train, K).transform(test), EMB_LABELS, "accuracy") for c in ("GNB", "LDA"))
    assert best >= base - 0.05


def _result(cv, std, test):
    return Result(Candidate("NOS", "NOR", "GNB"), cv, std, test)


def test_best_result_rules():
    best = _result(0.8, 0.05, 0.8)
    assert improves(_result(0.9, 0.05, 0.9), best) and not improves(_result(0.7, 0.05, 0.7), best)
    assert improves(_result(0.8, 0.01, 0.8), best) and improves(_result(0.79, 0.05, 0.82), best)
    assert not stable(_result(0.9, 0.01, 0.5))
    runs = [_result(0.9, 0.01, 0.5), _result(0.7, 0.1, 0.7), _result(0.8, 0.1, 0.8), _result(0.6, 0.1, 0.6)]
    assert pick_best(runs) is runs[2] and runs[0].exception.startswith("unstable")


def test_min_sample_size():
    assert N.min_sample_size(1000, 100, 0.1, 10) == math.ceil(max(math.ceil(3 / 0.1), 20) / 0.1)
    with pytest.raises(ValueError):
        N.min_sample_size(10, 0, 0.1, 10)


def test_dark_numbers_base_formula(spark):
    pred = spark.createDataFrame(
        [("a", 0.0, 0.0, [0.9, 0.1]), ("a", 0.0, 1.0, [0.4, 0.6]), ("b", 1.0, 1.0, [0.2, 0.8]), ("b", 1.0, 1.0, [0.3, 0.7])],
        "label string, label_idx double, prediction double, probability array<double>")
    pred = pred.withColumn("rate", F.array_max("probability"))
    d = {(r["type"], r["target"]): r["dark_number"] for r in N.dark_numbers(pred, ["a", "b"]).collect()}
    # target b: TN=1, FP=1 -> TNr 0.5; TP=2, FN=0 -> TPr 1
    assert abs(d[("base", "b")] - (1 - 0.5) * (2 - 1.0)) < 1e-9


def test_registered_learners_take_the_library_settings(spark, sf, monkeypatch):
    from loupe.operators.reduce import FittedReduction
    from loupe.plans import queries_learners as Q
    from loupe.plans import registry
    registry.load_all()
    fits, reductions = [], []

    def fit(code, train, k, **settings):
        fits.append((code, settings))
        return real_fit("DUMY", train, k)

    def reduce(code, train, k, algorithm=None, n=None):
        reductions.append((code, n))
        return FittedReduction(lambda df: df, None)
    real_fit = A.fit
    monkeypatch.setattr(Q.A, "fit", fit)
    monkeypatch.setattr(Q, "fit_reduction", reduce)
    for name in ("A5_gradient_boosting", "A6_hist_gradient_boosting", "A24_balanced_random_forest", "A27_easy_ensemble", "D8_nmf", "D9_n_components_used"):
        registry.QUERIES[name](spark, sf)
    assert fits == [(code, {}) for code in ("GBC", "HIST", "BARF", "EAEC")]
    assert len(reductions) == 9 and all(n is None for _, n in reductions)


def test_settings_reach_the_learner_and_unknown_ones_are_errors(spark, frame):
    from loupe.plans.spotcheck import cross_val_score, grid_search
    train = frame.filter("split = 'train'").withColumn("fold", F.pmod("vec_id", F.lit(2)))
    weights = [A.fit("LRN", train, K, C=c).model.coefficientMatrix.toArray() for c in (100.0, 1.0, 0.001)]
    sizes = [float(np.abs(w).sum()) for w in weights]
    assert sizes[0] > sizes[1] > sizes[2]
    scores = [sum(cross_val_score(train, K, EMB_LABELS, "LRN", 2, "f1_macro", C=c)) for c in (100.0, 1e-6)]
    assert scores[0] != scores[1]
    for code, bad in (("LRN", {"regularisation": 1.0}), ("GNB", {"alpha": 1.0}), ("MNB", {"C": 1.0}), ("ABC", {"depth": 2})):
        with pytest.raises((TypeError, ValueError)):
            A.fit(code, train, K, **bad)
    with pytest.raises(RuntimeError, match="every grid point failed"):
        grid_search(train, K, EMB_LABELS, "GNB", [{"nonsense": 1}, {"other": 2}], 2)
    with pytest.warns(UserWarning, match="nonsense"):
        best, score = grid_search(train, K, EMB_LABELS, "GNB", [{"nonsense": 1}, {"var_smoothing": 1e-3}], 2)
    assert best == {"var_smoothing": 1e-3} and score >= 0


def test_balanced_weights_give_every_class_the_same_total(spark):
    rows = [(float(i % 3 == 0) + float(i % 6 == 0),) for i in range(60)]
    df = A.balanced_weights(spark.createDataFrame(rows, "label_idx double"), 3)
    totals = [r[1] for r in df.groupBy("label_idx").agg(F.sum("weight")).collect()]
    assert max(totals) - min(totals) < 1e-9 and abs(sum(totals) - 60) < 1e-9
