"""Learners fitted from sums: cross-validation (E1) and correction factors (N10) without refitting.

DUMY, NCT, GNB, MNB, CNB and LDA depend on the rows only through each class's count, mean and squared
deviations (LDA: also one d x d scatter, which no label enters).  Those merge and can be taken apart, so one
grouped aggregate by (part, class) serves every fold: a fold's training sums are those of the other parts.
Standard, min-max and max-abs scaling are affine and fitted from the same sums; they are folded into the
model.  All folds are scored in one pass over Arrow batches.

Size: the driver and each task hold parts x classes x features numbers (LDA: parts x features^2), whatever the
number of rows.  ``supported`` says no above ``MAX_DIM`` features, and callers then fit fold by fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

FEATURES, LABEL, PRED, PROB = "features", "label_idx", "prediction", "probability"
ALGORITHMS = ("DUMY", "NCT", "GNB", "MNB", "CNB", "LDA")
SCALERS = ("NOS", "STA", "MIX", "MAX")
MAX_DIM = 1024  # features up to which parts x features^2 numbers are held


def supported(algorithm: str, scaler: str = "NOS", dim: int = 0) -> bool:
    return algorithm in ALGORITHMS and scaler in SCALERS and dim <= MAX_DIM


@dataclass
class Sums:
    """Per class: rows ``n`` (k), ``mean`` and squared deviations ``m2`` (k x d).  Over all classes: ``low`` and
    ``high`` (d) and, for LDA, ``scatter`` about ``centre``."""

    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    low: np.ndarray
    high: np.ndarray
    scatter: np.ndarray | None = None
    centre: np.ndarray | None = None

    @staticmethod
    def empty(k: int, d: int) -> "Sums":
        return Sums(np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), np.full(d, np.inf), np.full(d, -np.inf))

    def copy(self) -> "Sums":
        return Sums(self.n.copy(), self.mean.copy(), self.m2.copy(), self.low, self.high, self.scatter, self.centre)

    def add(self, c: int, n: float, mean: np.ndarray, m2: np.ndarray) -> None:
        """Rows that join class c."""
        if n:
            total, gap = self.n[c] + n, mean - self.mean[c]
            self.m2[c] = self.m2[c] + m2 + gap * gap * (self.n[c] * n / total)
            self.mean[c] = self.mean[c] + gap * (n / total)
            self.n[c] = total

    def remove(self, c: int, n: float, mean: np.ndarray, m2: np.ndarray) -> None:
        """Rows that leave class c."""
        left = self.n[c] - n
        if left <= 0:
            self.n[c], self.mean[c], self.m2[c] = 0, 0, 0
        elif n:
            rest = self.mean[c] + (self.mean[c] - mean) * (n / left)
            gap = rest - mean
            self.m2[c] = np.maximum(self.m2[c] - m2 - gap * gap * (left * n / self.n[c]), 0.0)
            self.n[c], self.mean[c] = left, rest

    def total(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Count, mean and squared deviations over all classes."""
        n = self.n.sum()
        mean = self.n @ self.mean / max(n, 1)
        return n, mean, self.m2.sum(axis=0) + self.n @ (self.mean - mean) ** 2


def grouped(df: DataFrame, by: list[str]) -> list[tuple[tuple, float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """One aggregate: (group, count, mean, squared deviations, min, max) of the features of every group."""
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                               Summarizer.metrics("mean", "variance", "min", "max").summary(F.col(FEATURES)).alias("_s")).collect()
    return [(tuple(int(r[b]) for b in by), float(r["_n"]), r["_s"]["mean"].toArray(),
             r["_s"]["variance"].toArray() * (r["_n"] - 1) if r["_n"] > 1 else np.zeros(len(r["_s"]["mean"])),
             r["_s"]["min"].toArray(), r["_s"]["max"].toArray()) for r in rows]


def _scatters(df: DataFrame, part: str, centre: np.ndarray) -> dict[int, np.ndarray]:
    """Sum of (x - centre)(x - centre)^T of every part; a task returns one d x d partial a part."""
    d = len(centre)

    def run(batches):
        import pandas as pd
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                Z, p = np.stack(pdf["x"].to_numpy()).astype(float) - centre, pdf["p"].to_numpy()
                for v in np.unique(p):
                    z = Z[p == v]
                    held[int(v)] = held.get(int(v), 0) + z.T @ z
        for v, m in held.items():
            yield pd.DataFrame({"p": [v], "m": [m.ravel().tolist()]})
    parts = df.select(F.col(part).cast("int").alias("p"), vector_to_array(F.col(FEATURES)).alias("x")).mapInPandas(run, "p int, m array<double>")
    rows = parts.groupBy("p").agg(Summarizer.sum(array_to_vector(F.col("m"))).alias("m")).collect()
    return {r["p"]: r["m"].toArray().reshape(d, d) for r in rows}


class PartSums:
    """The sums of every part (fold or split) of a frame, read once."""

    def __init__(self, df: DataFrame, k: int, part: str, scatter: bool = False):
        self.df, self.k, self.part = df, k, part
        self.rows = grouped(df.filter(F.col(LABEL).isNotNull() & F.col(part).isNotNull()), [part, LABEL])
        if not self.rows:
            raise ValueError("no labelled rows")
        self.dim = len(self.rows[0][2])
        self.parts = sorted({g[0] for g, *_ in self.rows})
        self.scatters: dict[int, np.ndarray] | None = None
        self.centre = None
        if scatter:
            self.with_scatter()

    def with_scatter(self) -> "PartSums":
        if self.scatters is None:
            self.centre = self.without(None).total()[1]
            self.scatters = _scatters(self.df.filter(F.col(LABEL).isNotNull()), self.part, self.centre)
        return self

    def without(self, held: int | None) -> Sums:
        """The training sums when part ``held`` is held out: the other parts, added up."""
        s = Sums.empty(self.k, self.dim)
        for (p, c), n, mean, m2, low, high in self.rows:
            if p != held:
                s.add(c, n, mean, m2)
                s.low, s.high = np.minimum(s.low, low), np.maximum(s.high, high)
        if self.scatters is not None:
            s.centre = self.centre
            s.scatter = sum((m for p, m in self.scatters.items() if p != held), np.zeros((self.dim, self.dim)))
        return s


def affine(scaler: str, s: Sums) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the scaler x -> a x + b fitted on the rows of ``s``."""
    d = len(s.low)
    if scaler == "NOS":
        return np.ones(d), np.zeros(d)
    if scaler == "STA":
        n, _, m2 = s.total()
        width, b = np.sqrt(m2 / max(n, 1)), np.zeros(d)
    elif scaler == "MAX":
        width, b = np.maximum(np.abs(s.low), np.abs(s.high)), np.zeros(d)
    elif scaler == "MIX":
        width, b = s.high - s.low, None
    else:
        raise KeyError(scaler)
    a = np.where(width > 0, 1.0 / np.where(width > 0, width, 1.0), 1.0)
    return a, (-s.low * a if b is None else b)


def closed_form(algorithm: str, s: Sums, scaler: str = "NOS", var_smoothing: float = 1e-9, alpha: float = 1.0,
                shrink: float = 1e-6) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """(b, W, (mu, w)): a row's score of class c is b_c + W_c.x + sum_j w_cj (x_j - mu_cj)^2 on the unscaled
    features.  A class without rows scores minus infinity."""
    a, shift = affine(scaler, s)
    n, N = s.n, s.n.sum()
    mean, m2 = s.mean * a + shift, s.m2 * a * a
    with np.errstate(divide="ignore"):
        prior = np.log(n / N)
    absent = np.where(n > 0, 0.0, -np.inf)
    k, d = mean.shape
    if algorithm == "DUMY":
        return prior, np.zeros((k, d)), None
    if algorithm == "GNB":
        var = m2 / np.maximum(n, 1)[:, None] + var_smoothing * float(np.max(s.total()[2] * a * a / N))
        b = prior - 0.5 * np.log(2 * np.pi * var).sum(axis=1)
        return b, np.zeros((k, d)), (s.mean, -a * a / (2 * var))
    if algorithm == "NCT":
        b, W = absent - (mean * mean).sum(axis=1), 2 * mean
    elif algorithm in ("MNB", "CNB"):
        if float((s.low * a + shift).min()) < 0:
            raise ValueError("Negative values in data passed to a count naive Bayes")
        total = mean * n[:, None]
        if algorithm == "CNB":
            other = total.sum(axis=0, keepdims=True) - total + alpha
            b, W = absent, -np.log(other / other.sum(axis=1, keepdims=True))
        else:
            b, W = prior, np.log((total + alpha) / (total.sum(axis=1, keepdims=True) + alpha * d))
    elif algorithm == "LDA":
        gap = s.mean - s.centre
        S = (s.scatter - (gap * n[:, None]).T @ gap) * np.outer(a, a) / max(N - k, 1.0)
        S = S + (shrink * np.trace(S) / max(d, 1) + 1e-12) * np.eye(d)
        W = np.linalg.solve(S, mean.T).T
        b = prior - 0.5 * (mean * W).sum(axis=1)
    else:
        raise KeyError(algorithm)
    return b + W @ shift, W * a, None


def class_scores(X: np.ndarray, b: np.ndarray, W: np.ndarray, quadratic) -> np.ndarray:
    S = b + X @ W.T
    if quadratic is not None:
        mu, w = quadratic
        for c in range(len(b)):
            S[:, c] += (X - mu[c]) ** 2 @ w[c]
    return S


def probabilities(S: np.ndarray) -> np.ndarray:
    e = np.exp(S - S.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scored(df: DataFrame, model_of, model: str, has_probability: bool = True) -> DataFrame:
    """``prediction`` and ``probability`` for rows with features, each by the model that column ``model``
    names; the features are left out.  ``model_of(id)`` returns a ``closed_form`` inside the task."""
    keep = [f for f in df.schema.fields if f.name not in (FEATURES, PRED, PROB)]
    rows = df.select(*[F.col(f"`{f.name}`") for f in keep], vector_to_array(F.col(FEATURES)).alias("_x"))
    schema = types.StructType(keep + [types.StructField(PRED, types.DoubleType()),
                                      types.StructField(PROB, types.ArrayType(types.DoubleType()))])

    def run(batches):
        known: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            X, ids = np.stack(pdf["_x"].to_numpy()).astype(float), pdf[model].to_numpy()
            best, prob = np.zeros(len(pdf)), [None] * len(pdf)
            for i in np.unique(ids):
                if i not in known:
                    known[i] = model_of(int(i))
                at = np.flatnonzero(ids == i)
                S = class_scores(X[at], *known[i])
                best[at] = S.argmax(axis=1)
                if has_probability:
                    for j, p in zip(at, probabilities(S)):
                        prob[j] = p.tolist()
            out = pdf.drop(columns="_x")
            out[PRED], out[PROB] = best, prob
            yield out
    return rows.mapInPandas(run, schema)


def out_of_fold(sums: PartSums, algorithm: str, scaler: str = "NOS", **settings) -> DataFrame:
    """Every row of the frame scored by the model of the other folds, in one pass."""
    if algorithm == "LDA":
        sums.with_scatter()
    models = {p: closed_form(algorithm, sums.without(p), scaler, **settings) for p in sums.parts}
    sent = sums.df.sparkSession.sparkContext.broadcast(models)
    return scored(sums.df.filter(F.col(LABEL).isNotNull() & F.col(sums.part).isNotNull()), lambda i: sent.value[i], sums.part,
                  algorithm != "NCT")


class ClosedForm:
    """A fitted closed-form learner with its scaler folded in: arrays only, so it can be stored as rows."""

    def __init__(self, algorithm: str, arrays: dict[str, np.ndarray]):
        self.algorithm, self.arrays = algorithm, arrays
        self.has_probability = algorithm != "NCT"

    def transform(self, df: DataFrame) -> DataFrame:
        a = self.arrays
        sent = df.sparkSession.sparkContext.broadcast((a["b"], a["W"], (a["mu"], a["w"]) if "w" in a else None))
        rows = df.drop(PRED, PROB).withColumn("_features", F.col(FEATURES)).withColumn("_model", F.lit(0))
        return scored(rows, lambda _: sent.value, "_model", self.has_probability).drop("_model").withColumnRenamed("_features", FEATURES)


def fit_closed_form(algorithm: str, train: DataFrame, k: int, scaler: str = "NOS", **settings) -> ClosedForm:
    """Scaler and learner fitted on all labelled rows, from one aggregate (LDA: and one scatter)."""
    if not supported(algorithm, scaler):
        raise ValueError(f"{algorithm} after {scaler} is not fitted from sums")
    sums = PartSums(train.withColumn("_part", F.lit(0)), k, "_part", algorithm == "LDA")
    b, W, quadratic = closed_form(algorithm, sums.without(None), scaler, **settings)
    return ClosedForm(algorithm, {"b": b, "W": W} | ({"mu": quadratic[0], "w": quadratic[1]} if quadratic else {}))
