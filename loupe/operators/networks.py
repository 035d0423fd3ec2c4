"""Learners trained by gradient steps: stochastic linear models (A12) and feed-forward networks.

Rows never leave the cluster.  A linear model is trained by mini-batches inside each partition, and the
partitions' weights are averaged after every epoch.  A network takes one step of Adam or SGD on the driver from
a gradient summed over a batch of the table.  Weights are features x classes, or layer-sized; a task returns one
array of that size.  The training rows are written once in hash order, so retries and reruns see the same order
and agree up to the rounding of sums, which are added as tasks finish.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from loupe.session import staged

FEATURES, LABEL, PRED, PROB = "features", "label_idx", "prediction", "probability"
# Activations and optimisers of the network codes (48 x 48 hidden units, 20 epochs, rate 0.02),
# and the settings of the wider network (100 hidden units, 200 epochs, rate 0.001).
NETWORKS = {
    "PYNN": dict(activation="tanh", optimizer="adam"), "FLAX": dict(activation="relu", optimizer="adam"),
    "TORA": dict(activation="relu", optimizer="adam"), "TORS": dict(activation="relu", optimizer="sgd"),
    "TOTA": dict(activation="tanh", optimizer="adam"), "TOTS": dict(activation="tanh", optimizer="sgd"),
    "TOSA": dict(activation="sigmoid", optimizer="adam"), "TOSS": dict(activation="sigmoid", optimizer="sgd"),
    "KERA": dict(activation="relu", optimizer="adam", hidden=(100,), epochs=200, rate=0.001)}
PATIENCE = 5  # epochs without a better loss after which training stops


def _summed(rows: DataFrame, fn, size: int) -> np.ndarray:
    """Sum over the tasks of ``fn(batches of (X, y))``, an array of ``size``."""
    def run(batches):
        import pandas as pd
        pairs = ((np.stack(p["x"].to_numpy()).astype(float), p["y"].to_numpy().astype(int)) for p in batches if len(p))
        out = fn(pairs)
        if out is not None:
            yield pd.DataFrame({"p": [np.asarray(out, float).ravel().tolist()]})
    parts = rows.select("x", "y").mapInPandas(run, "p array<double>")
    r = parts.agg(Summarizer.sum(array_to_vector(F.col("p"))).alias("s")).first()["s"]
    return np.zeros(size) if r is None else r.toArray()


def _training_rows(train: DataFrame, batches: int = 1) -> DataFrame:
    """x, y and a batch number by hash, spread evenly (also if a third of the rows are equal) and written once."""
    rows = train.filter(F.col(LABEL).isNotNull()).select(vector_to_array(F.col(FEATURES)).alias("x"), F.col(LABEL).cast("int").alias("y"))
    rows = rows.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_h", F.xxhash64("x", "y")).sortWithinPartitions("_h", "y")
    return staged(rows.withColumn("_b", F.pmod(F.xxhash64("_h", F.monotonically_increasing_id()), F.lit(batches)).cast("int")).drop("_h"), "training")


class GradientFitted:
    """Scores rows on Arrow batches by ``forward(weights, X)``, which returns scores and probabilities or None."""

    def __init__(self, spark, weights, forward, has_probability: bool):
        self.weights, self.forward, self.has_probability = weights, forward, has_probability
        self.sent = spark.sparkContext.broadcast(weights)

    def transform(self, df: DataFrame) -> DataFrame:
        base = df.drop(PRED, PROB)
        schema = types.StructType(base.schema.fields + [types.StructField(PRED, types.DoubleType()),
                                                        types.StructField(PROB, types.ArrayType(types.DoubleType()))])
        sent, forward = self.sent, self.forward

        def score(batches):
            for pdf in batches:
                if len(pdf):
                    S, P = forward(sent.value, np.stack(pdf["_x"].to_numpy()).astype(float))
                    out = pdf.drop(columns="_x")
                    out[PRED] = S.argmax(axis=1).astype(float)
                    out[PROB] = None if P is None else list(P)
                    yield out
        return base.withColumn("_x", vector_to_array(F.col(FEATURES))).mapInPandas(score, schema)


# ------------------------------------------------------------------ A12
def linear_loss(loss: str, M: np.ndarray, Y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of margins M against signs Y, and its derivative by M."""
    if loss == "hinge":
        return np.maximum(0.0, 1.0 - Y * M), np.where(Y * M < 1.0, -Y, 0.0)
    if loss == "log_loss":
        return np.logaddexp(0.0, -Y * M), -Y * 0.5 * (1.0 - np.tanh(0.5 * Y * M))
    raise ValueError("loss is 'hinge' or 'log_loss'")


def _linear_forward(loss):
    def forward(W, X):
        S = X @ W[:, :-1].T + W[:, -1]
        if loss == "hinge":
            return S, None
        p = 0.5 * (1.0 + np.tanh(0.5 * S))
        return S, p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    return forward


def fit_sgd(train: DataFrame, k: int, loss: str = "hinge", alpha: float = 1e-4, epochs: int = 50, tol: float = 1e-3,
            batch: int = 8) -> GradientFitted:
    """One-vs-rest linear models with the mean ``loss`` + alpha/2 |w|^2, by mini-batches of ``batch`` rows in
    every partition, which are averaged by their rows.  The step is 4 / mean squared row norm, halved after an epoch that lowers the loss by less than ``tol`` of it; ``PATIENCE`` such epochs in a row end
    the training.  The weights with the lowest loss on all rows are kept, the average of the last ten epochs
    among them.  Log loss has probabilities."""
    linear_loss(loss, np.zeros(1), np.ones(1))
    rows = _training_rows(train)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.avg(
        F.aggregate("x", F.lit(1.0), lambda a, v: a + v * v)).alias("norm")).first()
    n, d = sizes["n"], sizes["d"]
    if not n:
        raise ValueError("no labelled rows")
    sc = train.sparkSession.sparkContext

    def epoch(W0, step):
        """Summed loss at W0, and the partitions' weights after a pass, weighted by their rows."""
        sent = sc.broadcast(W0)

        def run(pairs):
            W, total, seen = sent.value, 0.0, 0
            for X, y in pairs:
                X = np.hstack([X, np.ones((len(X), 1))])
                Y = np.where(y[:, None] == np.arange(k), 1.0, -1.0)
                total += linear_loss(loss, X @ sent.value.T, Y)[0].sum()
                seen += len(X)
                for i in range(0, len(X) if step else 0, batch):
                    x = X[i:i + batch]
                    G = linear_loss(loss, x @ W.T, Y[i:i + batch])[1].T @ x / len(x)
                    G[:, :-1] += alpha * W[:, :-1]
                    W = W - step * G
            return np.concatenate([[total], (W * seen).ravel()]) if seen else None
        s = _summed(rows, run, 1 + k * (d + 1))
        return s[0] / n + 0.5 * alpha * float((W0[:, :-1] ** 2).sum()), s[1:].reshape(k, d + 1) / n

    W, step = np.zeros((k, d + 1)), 4.0 / sizes["norm"]
    best, best_W, waited, late = np.inf, None, 0, []
    for e in range(epochs + 1):
        value, after = epoch(W, step if e < epochs else 0.0)
        waited = 0 if value < best * (1 - tol) else waited + 1
        if value < best:
            best, best_W = value, W
        if waited >= PATIENCE or e == epochs:
            break
        if waited:
            step /= 2
        W = after
        late = (late + [W])[-10:]
    if late:
        mean = np.mean(late, axis=0)
        value, _ = epoch(mean, 0.0)
        if value < best:
            best, best_W = value, mean
    out = GradientFitted(train.sparkSession, best_W, _linear_forward(loss), loss == "log_loss")
    out.loss, out.feature_weights = float(best), np.abs(best_W[:, :-1]).sum(axis=0)
    return out


# ------------------------------------------------------------------ A33
def _activate(name: str, Z: np.ndarray) -> np.ndarray:
    if name == "relu":
        return np.maximum(Z, 0.0)
    return np.tanh(Z) if name == "tanh" else 0.5 * (1.0 + np.tanh(0.5 * Z))


def _slope(name: str, A: np.ndarray) -> np.ndarray:
    """Derivative of the activation, from its value."""
    if name == "relu":
        return (A > 0).astype(float)
    return 1.0 - A * A if name == "tanh" else A * (1.0 - A)


def unpacked(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) of every layer."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _forward(flat, layers, activation, X):
    values = [X]
    steps = unpacked(flat, layers)
    for i, (W, b) in enumerate(steps):
        Z = values[-1] @ W + b
        values.append(_activate(activation, Z) if i < len(steps) - 1 else Z)
    S = values[-1]
    E = np.exp(S - S.max(axis=1, keepdims=True))
    return values, E / E.sum(axis=1, keepdims=True)


def loss_and_gradient(flat: np.ndarray, layers: list[int], activation: str, X: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of a batch and its gradient by all weights (back-propagation)."""
    values, P = _forward(flat, layers, activation, X)
    loss = float(-np.log(np.maximum(P[np.arange(len(y)), y], 1e-300)).sum())
    delta = P.copy()
    delta[np.arange(len(y)), y] -= 1.0
    parts = []
    steps = unpacked(flat, layers)
    for i in range(len(steps) - 1, -1, -1):
        parts = [(values[i].T @ delta).ravel(), delta.sum(axis=0)] + parts
        if i:
            delta = delta @ steps[i][0].T * _slope(activation, values[i])
    return loss, np.concatenate(parts)


def fit_network(train: DataFrame, k: int, hidden: tuple[int, ...] = (48, 48), activation: str = "tanh", optimizer: str = "adam",
                rate: float = 0.02, epochs: int = 20, batches: int = 8, seed: int = 42) -> GradientFitted:
    """Dense layers with softmax cross-entropy.  An epoch takes ``batches`` steps, each from the mean gradient
    of the rows of one hash batch; training ends after ``PATIENCE`` epochs without a lower training loss, and the
    weights of the best epoch stay.  There is no dropout.  ``sgd`` has momentum 0.9."""
    if activation not in ("relu", "tanh", "sigmoid"):
        raise ValueError("activation is 'relu', 'tanh' or 'sigmoid'")
    if optimizer not in ("adam", "sgd"):
        raise ValueError("optimizer is 'adam' or 'sgd'")
    rows = _training_rows(train, batches).persist()
    try:
        d = rows.agg(F.max(F.size("x")).alias("d")).first()["d"]
        if d is None:
            raise ValueError("no labelled rows")
        layers = [d, *hidden, k]
        rng = np.random.default_rng(seed)
        flat = np.concatenate([np.concatenate([rng.normal(0, np.sqrt((2.0 if activation == "relu" else 1.0) / a), a * b), np.zeros(b)])
                               for a, b in zip(layers, layers[1:])])
        m, v, t = np.zeros_like(flat), np.zeros_like(flat), 0
        best, best_flat, waited, losses = np.inf, flat, 0, []
        for _ in range(epochs):
            total, count = 0.0, 0.0
            for b in range(batches):
                sent = train.sparkSession.sparkContext.broadcast(flat)

                def run(pairs):
                    out = None
                    for X, y in pairs:
                        loss, g = loss_and_gradient(sent.value, layers, activation, X, y)
                        out = np.concatenate([[len(y), loss], g]) + (0 if out is None else out)
                    return out
                s = _summed(rows.filter(F.col("_b") == b), run, 2 + len(flat))
                if not s[0]:
                    continue
                t, g, total, count = t + 1, s[2:] / s[0], total + s[1], count + s[0]
                if optimizer == "adam":
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    flat = flat - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
                else:
                    m = 0.9 * m + g
                    flat = flat - rate * m
            losses.append(total / count)
            waited = 0 if losses[-1] < best else waited + 1
            if losses[-1] < best:
                best, best_flat = losses[-1], flat
            if waited >= PATIENCE:
                break
    finally:
        rows.unpersist()

    def forward(w, X):
        P = _forward(w, layers, activation, X)[1]
        return P, P
    out = GradientFitted(train.sparkSession, best_flat, forward, True)
    out.losses = losses
    return out
