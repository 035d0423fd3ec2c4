"""Feature reduction (D1-D9) on the ``features`` vector, fitted on training rows.

* PCA: Spark ML ``PCA`` after explicit centring (Spark's PCA does not centre at transform);
  the component count is the smallest reaching 95 % explained variance.
* TSVD: ``RowMatrix.computeSVD`` (distributed), projection by V without centring.
* GRP: a seeded Gaussian matrix (d x m, Johnson-Lindenstrauss size) applied per row.
* NYS: Nystroem RBF map with m landmarks sampled by hash (m x m eigen-solve on the driver).
* RFE: recursive elimination with a binary search on the number of kept features, ranked by
  the candidate's own coefficients / importances.
Driver-side state is bounded by d x components (or m x m), never by rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = "features"
VARIANCE_SHARE = 0.95  # fixed value
# Reduction codes.
REDUCTIONS = {"NOR": "No reduction", "RFE": "Recursive feature elimination", "PCA": "Principal component analysis",
              "NYS": "Nystroem kernel approximation", "TSVD": "Truncated SVD", "FICA": "Fast independent component analysis",
              "NMF": "Non-negative matrix factorisation", "GRP": "Gaussian random projection"}


class FittedReduction:
    def __init__(self, fn, components: int | None = None):
        self.fn, self.components = fn, components

    def transform(self, df: DataFrame) -> DataFrame:
        return self.fn(df)


def _dim(df: DataFrame) -> int:
    return int(df.select(F.size(vector_to_array(F.col(FEATURES))).alias("d")).first()["d"])


def _matmul(df: DataFrame, M: np.ndarray, shift: np.ndarray | None = None) -> DataFrame:
    """x -> (x - shift) @ M on Arrow batches (M is d x m and travels with the function, not in the plan)."""
    return batch_map(df, lambda X: (X if shift is None else X - shift) @ M)


def batch_sums(df: DataFrame, fn, size: int) -> np.ndarray:
    """Sum ``fn(X)`` (a 1-d array of ``size``) over the rows' feature matrix, one Arrow batch
    at a time.  Each batch emits one partial; the partials are added by ``Summarizer`` with
    map-side partial aggregation, so neither rows nor per-batch partials reach the driver."""
    def part(batches):
        import pandas as pd
        for pdf in batches:
            if len(pdf):
                X = np.stack(pdf["x"].to_numpy()).astype(float)
                yield pd.DataFrame({"p": [np.asarray(fn(X), dtype=float).ravel().tolist()]})
    parts = df.select(vector_to_array(F.col(FEATURES)).alias("x")).mapInPandas(part, "p array<double>")
    r = parts.select(Summarizer.sum(array_to_vector(F.col("p"))).alias("s")).first()["s"]
    return np.zeros(size) if r is None else r.toArray()


def sum_of_batches(df: DataFrame, fn, size: int) -> np.ndarray:
    """Like ``batch_sums`` for functions of the feature matrix and the integer labels."""
    def part(batches):
        import pandas as pd
        for pdf in batches:
            if len(pdf):
                X = np.stack(pdf["x"].to_numpy()).astype(float)
                yield pd.DataFrame({"p": [np.asarray(fn(X, pdf["y"].to_numpy().astype(int)), dtype=float).ravel().tolist()]})
    rows = df.select(vector_to_array(F.col(FEATURES)).alias("x"), F.col("label_idx").alias("y"))
    r = rows.mapInPandas(part, "p array<double>").select(Summarizer.sum(array_to_vector(F.col("p"))).alias("s")).first()["s"]
    return np.zeros(size) if r is None else r.toArray()


def batch_map(df: DataFrame, fn) -> DataFrame:
    """Replace ``features`` by ``fn(X)`` row-wise on Arrow batches (numpy inside the task)."""
    base = df.withColumn(FEATURES, vector_to_array(F.col(FEATURES)))
    schema = base.schema

    def run(batches):
        for pdf in batches:
            if len(pdf):
                X = np.stack(pdf[FEATURES].to_numpy()).astype(float)
                pdf[FEATURES] = list(np.asarray(fn(X), dtype=float))
            yield pdf
    return base.mapInPandas(run, schema).withColumn(FEATURES, array_to_vector(F.col(FEATURES)))


def fit_pca(train: DataFrame, n: int | None = None) -> FittedReduction:
    d = _dim(train)
    k_max = min(d, max(1, train.count() - 1))
    centre = StandardScaler(withMean=True, withStd=False, inputCol=FEATURES, outputCol="_c").fit(train)
    ct = centre.transform(train)
    pca = PCA(k=k_max, inputCol="_c", outputCol="_p").fit(ct)
    ev = np.cumsum(pca.explainedVariance.toArray())
    k = n or int(min(k_max, np.searchsorted(ev, VARIANCE_SHARE * ev[-1] if ev[-1] < 1 else VARIANCE_SHARE) + 1))
    pc = pca.pc.toArray()[:, :k]
    mean = centre.mean.toArray()
    return FittedReduction(lambda df: _matmul(df, pc, mean), k)


#: Fixed value: components that TSVD and Nystroem keep at least, if the data have them.
COMPONENTS_LEAST = 100


def components_floor(n: int, d: int) -> int:
    """max(100, min(n, d)) components, but no more than there are (features for an exact projection)."""
    return max(1, min(max(COMPONENTS_LEAST, min(n, d)), d))


def fit_tsvd(train: DataFrame, n: int | None = None) -> FittedReduction:
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils
    d = _dim(train)
    k = n or components_floor(train.count(), d)
    old = MLUtils.convertVectorColumnsFromML(train.select(FEATURES), FEATURES)
    rm = RowMatrix(old)
    svd = rm.computeSVD(k, computeU=False)
    V = svd.V.toArray()
    return FittedReduction(lambda df: _matmul(df, V), V.shape[1])


def jl_components(n: int, eps: float = 0.1) -> int:
    return int(4 * math.log(max(n, 2)) / (eps ** 2 / 2 - eps ** 3 / 3))


def fit_grp(train: DataFrame, n: int | None = None, seed: int = 42) -> FittedReduction:
    d = _dim(train)
    m = n or min(d, jl_components(train.count()))
    rng = np.random.default_rng(seed)
    R = rng.normal(0.0, 1.0 / math.sqrt(m), size=(d, m))
    return FittedReduction(lambda df: _matmul(df, R), m)


def fit_nystroem(train: DataFrame, n: int | None = None, seed: int = 42, gamma: float | None = None) -> FittedReduction:
    """M landmarks chosen by the smallest seeded hash keys (a top-m, not a collect of rows)."""
    d = _dim(train)
    rows = max(1, train.count())
    m = n or min(max(COMPONENTS_LEAST, min(rows, d)), rows)
    land = (train.withColumn("_h", F.xxhash64(vector_to_array(F.col(FEATURES)).cast("string"), F.lit(seed)))
            .orderBy("_h").limit(m).select(vector_to_array(F.col(FEATURES)).alias("x")).collect())
    Z = np.array([r["x"] for r in land])
    g = gamma if gamma is not None else 1.0 / d
    K = np.exp(-g * ((Z[:, None, :] - Z[None, :, :]) ** 2).sum(-1))
    U, S, _ = np.linalg.svd(K)
    norm = U / np.sqrt(np.maximum(S, 1e-12))

    def kernel(X):
        d2 = (X * X).sum(axis=1)[:, None] + (Z * Z).sum(axis=1)[None, :] - 2 * X @ Z.T
        return np.exp(-g * np.maximum(d2, 0)) @ norm

    def tr(df: DataFrame) -> DataFrame:
        return batch_map(df, kernel)
    return FittedReduction(tr, len(Z))


def fit_fica(train: DataFrame, n: int | None = None, seed: int = 42, iters: int = 200, tol: float = 1e-4) -> FittedReduction:
    """Whitening by PCA, then symmetric FastICA (logcosh).  Each fixed-point iteration is
    one distributed pass: per batch, G = tanh(X W^T) gives partial sums of G^T X and
    sum(1 - G^2); only k x k numbers come back."""
    pca = fit_pca(train, n)
    w = pca.transform(train)
    k = pca.components
    mom = batch_sums(w, lambda X: np.concatenate([[len(X)], X.sum(axis=0), (X * X).sum(axis=0)]), 2 * k + 1)
    n_rows = max(mom[0], 1.0)
    sd = np.sqrt(np.maximum(mom[1 + k:] / n_rows - (mom[1:1 + k] / n_rows) ** 2, 0.0))
    sd = np.where(sd > 0, sd, 1.0)
    white = batch_map(w, lambda X: X / sd).persist()
    rng = np.random.default_rng(seed)
    W = np.linalg.qr(rng.normal(size=(k, k)))[0]

    def step(Wc):
        def fn(X):
            G = np.tanh(X @ Wc.T)
            return np.concatenate([(G.T @ X).ravel(), (1 - G * G).sum(axis=0)])
        return fn
    for _ in range(iters):
        r = batch_sums(white, step(W), k * k + k)
        a, b = r[:k * k].reshape(k, k) / n_rows, r[k * k:] / n_rows
        W_new = a - b[:, None] * W
        u_, _s, vt_ = np.linalg.svd(W_new)
        W_new = u_ @ vt_
        done = np.max(np.abs(np.abs(np.diag(W_new @ W.T)) - 1)) < tol
        W = W_new
        if done:
            break
    white.unpersist()
    M = (W / sd[None, :]).T  # applied after the PCA projection

    def tr(df: DataFrame) -> DataFrame:
        return batch_map(pca.transform(df), lambda X: X @ M)
    return FittedReduction(tr, k)


def fit_rfe(train: DataFrame, k: int, algorithm: str, labels_metric=None) -> FittedReduction:
    """Keep the features ranked highest by the estimator's weights, the count chosen by a
    binary search on the score (upper := n when the score holds, lower := n otherwise)."""
    from loupe.operators import classifiers as A
    from loupe.operators import metrics as M
    d = _dim(train)
    tr = train.filter(F.col("fold") != 0)
    te = train.filter(F.col("fold") == 0)
    labels = [str(i) for i in range(k)]

    def sliced(df: DataFrame, kept: list[int]) -> DataFrame:
        sl = VectorSlicer(inputCol=FEATURES, outputCol="_s", indices=kept)
        return sl.transform(df).drop(FEATURES).withColumnRenamed("_s", FEATURES)

    def fit_on(kept: list[int]) -> tuple[float, list[int]]:
        """Score on the held-out fold, and the kept features from the weightiest on."""
        m = A.fit(algorithm, sliced(tr, kept), k)
        order = np.argsort(-feature_weights(m), kind="stable")
        return M.score_value(m.transform(sliced(te, kept)), labels, "accuracy"), [kept[i] for i in order]

    kept = list(range(d))
    best, order = fit_on(kept)
    lo, hi, ranked = 1, d, order
    nxt = math.ceil((lo + hi) / 2)
    while nxt != hi and hi - lo > 1:
        s, again = fit_on(sorted(ranked[:nxt]))
        if s >= best:  # go on from the features that the smaller model ranks
            hi, best, ranked, kept = nxt, s, again, sorted(ranked[:nxt])
        else:
            lo = nxt
        nxt = math.ceil((lo + hi) / 2)
    return FittedReduction(lambda df: sliced(df, kept), len(kept))


def feature_weights(model) -> np.ndarray:
    """Weight of each feature in a fitted model: absolute coefficients or importances, added up over the
    members of an ensemble.  A model without any is refused."""
    inner = getattr(model, "model", None)
    for one in (inner, model):
        if one is not None and hasattr(one, "coefficientMatrix"):
            return np.abs(one.coefficientMatrix.toArray()).sum(axis=0)
        if one is not None and hasattr(one, "featureImportances"):
            return one.featureImportances.toArray()
        if one is not None and hasattr(one, "coefficients"):
            return np.abs(one.coefficients.toArray())
    if hasattr(model, "feature_weights"):
        return np.asarray(model.feature_weights, float)
    members = getattr(model, "members", None) or getattr(model, "models", None)
    if members:
        return sum(feature_weights(m) for m in members)
    raise ValueError("recursive elimination needs an estimator that weighs its features")


def _nmf_project(X: np.ndarray, H: np.ndarray, steps: int = 30) -> np.ndarray:
    """Non-negative codes W for rows X with H fixed (multiplicative updates)."""
    HHt = H @ H.T
    XHt = np.maximum(X @ H.T, 0.0)
    W = XHt / max(float(np.trace(HHt)), 1e-12) + 1e-6
    for _ in range(steps):
        W = W * XHt / (W @ HHt + 1e-12)
    return W


def fit_nmf(train: DataFrame, n: int | None = None, iters: int = 100, seed: int = 42,
            target_error: float = 0.05) -> FittedReduction:
    """Non-negative factorisation X ~ W H.  H (m x d) lives on the driver; every update
    is one distributed pass whose batches project their rows on H and return partial W^T X
    and W^T W.  Like the reference's helper, the component count doubles (from 2) until the
    relative reconstruction error drops below 5 % or reaches d, unless ``n`` is given."""
    d = _dim(train)
    base = train.select(FEATURES).persist()
    lowest = base.select(F.min(F.array_min(vector_to_array(F.col(FEATURES)))).alias("m")).first()["m"]
    if lowest is not None and lowest < 0:
        raise ValueError("Negative values in data passed to NMF")
    norm_x = float(np.sqrt(batch_sums(base, lambda X: np.array([(X * X).sum()]), 1)[0])) or 1.0

    def fit_h(m):
        H = np.abs(np.random.default_rng(seed).normal(size=(m, d))) + 1e-3
        for _ in range(iters):
            Hc = H

            def fn(X, Hc=Hc):
                Wr = _nmf_project(X, Hc)
                return np.concatenate([(Wr.T @ X).ravel(), (Wr.T @ Wr).ravel()])
            r = batch_sums(base, fn, m * d + m * m)
            WtX, WtW = r[:m * d].reshape(m, d), r[m * d:].reshape(m, m)
            H = H * WtX / (WtW @ H + 1e-12)
        Hc = H
        err = np.sqrt(batch_sums(base, lambda X: np.array([((X - _nmf_project(X, Hc) @ Hc) ** 2).sum()]), 1)[0])
        return H, err / norm_x

    if n:
        H, _ = fit_h(n)
    else:
        m = min(2, d)
        while True:
            H, rel = fit_h(m)
            if rel < target_error or m >= d:
                break
            m = min(d, m * 2)
    base.unpersist()
    Hf = H

    def tr(df: DataFrame) -> DataFrame:
        return batch_map(df, lambda X: _nmf_project(X, Hf))
    return FittedReduction(tr, Hf.shape[0])


def fit_reduction(code: str, train: DataFrame, k: int, algorithm: str | None = None, n: int | None = None) -> FittedReduction:
    if code == "NOR":
        return FittedReduction(lambda df: df, None)
    if code == "PCA":
        return fit_pca(train, n)
    if code == "TSVD":
        return fit_tsvd(train, n)
    if code == "GRP":
        return fit_grp(train, n)
    if code == "NYS":
        return fit_nystroem(train, n)
    if code == "FICA":
        return fit_fica(train, n)
    if code == "NMF":
        return fit_nmf(train, n)
    if code == "RFE":
        return fit_rfe(train, k, algorithm or "LRN")
    raise KeyError(code)
