"""Gradient learners: gradients by finite differences, losses against plain numpy, reruns and hard shapes."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loupe.operators import classifiers as A
from loupe.operators import networks as G


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes that no line separates, a third of the rows on one point."""
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 2 * np.pi, 400)
    y = np.arange(400) % 2
    X = np.stack([np.cos(a), np.sin(a)], 1) * (0.5 + y[:, None]) + rng.normal(0, 0.05, (400, 2))
    X[:134], y[:134] = [0.5, 0.0], 0
    rows = [(i, float(y[i]), X[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label_idx double, x array<double>")
    return df.withColumn("features", array_to_vector("x")).drop("x").cache()


@pytest.mark.parametrize("activation", ["relu", "tanh", "sigmoid"])
def test_gradient_by_finite_differences(activation):
    rng = np.random.default_rng(0)
    layers = [3, 5, 4, 3]
    X, y = rng.normal(size=(7, 3)), rng.integers(0, 3, 7)
    w = rng.normal(size=sum(a * b + b for a, b in zip(layers, layers[1:])))
    _, g = G.loss_and_gradient(w, layers, activation, X, y)
    for i in range(0, len(w), 3):
        e = np.zeros_like(w)
        e[i] = 1e-6
        up, down = (G.loss_and_gradient(w + s * e, layers, activation, X, y)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("optimizer,activation", [("adam", "relu"), ("sgd", "tanh")])
def test_networks_learn_what_no_line_separates(rings, optimizer, activation):
    m = G.fit_network(rings, 2, hidden=(16,), activation=activation, optimizer=optimizer, rate=0.05 if optimizer == "adam" else 0.3, epochs=25, batches=2)
    assert m.losses[-1] < 0.5 * m.losses[0]
    rows = m.transform(rings).collect()
    assert len(rows) == 400 and np.mean([r["prediction"] == r["label_idx"] for r in rows]) > 0.93
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in rows)


def _batch_optimum(X, Y, loss, alpha):
    """Full-batch descent with a small step, long enough to settle."""
    X = np.hstack([X, np.ones((len(X), 1))])
    W, best = np.zeros((Y.shape[1], X.shape[1])), np.inf
    for t in range(20000):
        L, D = G.linear_loss(loss, X @ W.T, Y)
        best = min(best, L.sum() / len(X) + 0.5 * alpha * (W[:, :-1] ** 2).sum())
        g = D.T @ X / len(X)
        g[:, :-1] += alpha * W[:, :-1]
        W -= 0.5 / np.sqrt(1 + t / 100) * g
    return best


@pytest.mark.parametrize("loss", ["hinge", "log_loss"])
def test_sgd_comes_near_the_batch_optimum_and_reruns_agree(spark, loss):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 600)
    X = rng.normal(size=(600, 3)) + np.eye(3)[y] * 1.5
    df = spark.createDataFrame([(float(c), x.tolist()) for c, x in zip(y, X)], "label_idx double, x array<double>").orderBy("label_idx")
    df = df.withColumn("features", array_to_vector("x")).drop("x")
    m = G.fit_sgd(df, 3, loss=loss, alpha=1e-2, tol=1e-4)
    want = _batch_optimum(X, np.where(y[:, None] == np.arange(3), 1.0, -1.0), loss, 1e-2)
    assert want * 0.999 <= m.loss <= want * 1.02
    assert np.allclose(m.weights, G.fit_sgd(df, 3, loss=loss, alpha=1e-2, tol=1e-4).weights, rtol=1e-6)  # sums round by task order
    assert m.has_probability == (loss == "log_loss")
    rows = m.transform(df).collect()
    assert np.mean([r["prediction"] == r["label_idx"] for r in rows]) > 0.7
    assert all((r["probability"] is None) == (loss == "hinge") for r in rows)


def test_settings_are_checked(rings):
    for code, bad in (("SGDE", {"C": 1.0}), ("PYNN", {"layers": 3}), ("TORA", {"alpha": 1.0})):
        with pytest.raises(TypeError):
            A.fit(code, rings, 2, **bad)
    for code, bad in (("SGDE", {"loss": "squared"}), ("KERA", {"activation": "step"}), ("FLAX", {"optimizer": "rms"})):
        with pytest.raises(ValueError):
            A.fit(code, rings, 2, **bad)
    none = rings.filter(F.col("id") < 0)
    for code in ("SGDE", "PYNN"):
        with pytest.raises(ValueError, match="no labelled rows"):
            A.fit(code, none, 2)
