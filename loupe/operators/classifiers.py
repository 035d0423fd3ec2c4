"""Classifier registry (A1-A33) keyed by the reference's algorithm codes.

Frame convention: ``features`` (ml Vector), ``label_idx`` (double, 0..k-1 in sorted-label
order), optional ``weight``.  Every fitted model's ``transform`` adds ``prediction``
(double) and ``probability`` (array<double>, or null when the method has none, which makes
the rate -1 downstream).

Built-in Spark ML estimators are used wherever they exist.  Composed models (DUMY, NCT, GNB,
LDA, QDA, ridge, one-vs-rest with probabilities, boosting/bagging loops, voting, stacking,
self-training) fit with grouped aggregates — at most one row per class per task is shuffled,
so a class holding a third of all rows costs nothing extra — and keep only class-sized
parameters (k x d) on the driver.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Callable

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import classification as C
from pyspark.ml import regression as Rg
from pyspark.ml.feature import Binarizer, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from loupe.operators import trees as T
from loupe.operators.networks import NETWORKS, fit_network, fit_sgd
from loupe.session import cut_lineage, staged

FEATURES, LABEL, PRED, PROB, WEIGHT, KEY = "features", "label_idx", "prediction", "probability", "weight", "_key"
# The reference library's defaults.  Trees grow without a depth limit there; 30 is the
# deepest that Spark ML allows.
TREE_DEPTH, BOOSTING_ROUNDS, EASY_ROUNDS, HIDDEN, HIDDEN_LIGHT = 30, 100, 50, (100,), (50,)
#: Classes of a one-vs-rest that are fitted at once.
OVR_AT_ONCE = 8
_TAGS = itertools.count()  # unique scratch-column prefixes, so nested ensembles do not collide


# ------------------------------------------------------------------ helpers
def lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def argmax(scores: Column) -> Column:
    """Index of the largest element (first on ties)."""
    m = F.array_max(scores)
    return F.array_position(scores, m).cast("double") - 1.0


def softmax(scores: Column) -> Column:
    m = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - m))
    tot = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / tot)


def class_counts(df: DataFrame, k: int) -> np.ndarray:
    rows = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()
    out = np.zeros(k)
    for r in rows:
        out[int(r[LABEL])] = r["n"]
    return out


def class_stats(df: DataFrame, k: int, x: str = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per-class count, mean and population variance of each feature (one grouped aggregate)."""
    rows = (df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"),
                                  Summarizer.metrics("mean", "variance").summary(F.col(x)).alias("s"))
            .collect())
    d = len(rows[0]["s"]["mean"])
    n, mu, var = np.zeros(k), np.zeros((k, d)), np.zeros((k, d))
    for r in rows:
        i = int(r[LABEL])
        n[i] = r["n"]
        mu[i] = r["s"]["mean"].toArray()
        v = r["s"]["variance"].toArray()
        var[i] = v * (n[i] - 1) / n[i] if n[i] > 1 else 0.0 * v
    return n, mu, var


def feature_dim(df: DataFrame) -> int:
    return int(df.select(F.size(vector_to_array(F.col(FEATURES))).alias("d")).first()["d"])


# ------------------------------------------------------------------ model wrappers
class Fitted:
    has_probability = True

    def transform(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError


class SparkFitted(Fitted):
    """A fitted Spark ML model; probability vector -> array."""

    def __init__(self, model, has_probability=True):
        self.model = model
        self.has_probability = has_probability

    def transform(self, df: DataFrame) -> DataFrame:
        cols = [c for c in ("rawPrediction", PROB, PRED) if c in df.columns]
        out = self.model.transform(df.drop(*cols))
        prob = vector_to_array(F.col(PROB)) if (self.has_probability and PROB in out.columns) \
            else F.lit(None).cast("array<double>")
        out = out.withColumn(PROB, prob)
        return out.drop("rawPrediction")


class ScoreFitted(Fitted):
    """Composed model: per-row class scores from a column expression on the dense array x."""

    def __init__(self, score_fn: Callable[[Column], Column], probs: bool = True, is_prob: bool = False,
                 prob_fn: Callable[[Column], Column] | None = None):
        self.score_fn, self.has_probability, self.is_prob, self.prob_fn = score_fn, probs, is_prob, prob_fn

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(FEATURES))
        out = df.drop(PRED, PROB).withColumn("_scores", self.score_fn(x))
        out = out.withColumn(PRED, argmax(F.col("_scores")))
        if self.has_probability:
            p = F.col("_scores") if self.is_prob else (self.prob_fn(F.col("_scores")) if self.prob_fn
                                                       else softmax(F.col("_scores")))
            out = out.withColumn(PROB, p)
        else:
            out = out.withColumn(PROB, F.lit(None).cast("array<double>"))
        return out.drop("_scores")

    def weighed(self, weights) -> "ScoreFitted":
        """Keeps a weight for each feature (recursive elimination ranks by it)."""
        self.feature_weights = np.asarray(weights, float)
        return self


DENSE_EXPR_MAX_DIM = 128  # up to this many features, scores are JVM column expressions


def _dense_rows(feats) -> "np.ndarray":
    """A pandas column of vector dicts -> (indptr, indices, values, n, d) in CSR layout."""
    n = len(feats)
    idx, val, lens = [], [], np.zeros(n, dtype=np.int64)
    d = 0
    for i, v in enumerate(feats):
        if v["type"] == 0:
            idx.append(np.asarray(v["indices"], dtype=np.int64))
            val.append(np.asarray(v["values"], dtype=np.float64))
            d = max(d, int(v["size"]))
        else:
            vals = np.asarray(v["values"], dtype=np.float64)
            idx.append(np.arange(len(vals), dtype=np.int64))
            val.append(vals)
            d = max(d, len(vals))
        lens[i] = len(val[-1])
    rows = np.repeat(np.arange(n), lens)
    return rows, (np.concatenate(idx) if idx else np.zeros(0, np.int64)), \
        (np.concatenate(val) if val else np.zeros(0)), n


class LinearScoreFitted(Fitted):
    """Scores b + X W1^T for sparse or dense vectors, evaluated on Arrow batches; with W2 = (mu, w) also the
    weighted squared distances sum w (x - mu)^2, of which b holds the part of an all-zero row.

    W1 and W2 are k x d (classes x features) and travel once per executor as a broadcast
    variable; rows are never collected.  ``mode``: 'softmax' -> probabilities, 'none' -> no
    probabilities."""

    def __init__(self, spark, b, W1, W2=None, mode: str = "softmax"):
        self.k = len(b)
        self.bc = spark.sparkContext.broadcast((np.asarray(b, float), np.asarray(W1, float),
                                                None if W2 is None else tuple(np.asarray(w, float) for w in W2)))
        self.mode = mode
        self.has_probability = mode != "none"
        self.feature_weights = np.abs(np.asarray(W1, float) - np.asarray(W1, float).mean(axis=0)).sum(axis=0)

    def transform(self, df: DataFrame) -> DataFrame:
        base = df.drop(PRED, PROB)
        schema = types.StructType(base.schema.fields + [types.StructField(PRED, types.DoubleType()),
                                                        types.StructField(PROB, types.ArrayType(types.DoubleType()))])
        bc, mode = self.bc, self.mode

        def score(batches):
            b, W1, W2 = bc.value
            for pdf in batches:
                rows, idx, val, n = _dense_rows(pdf[FEATURES])
                S = np.tile(b, (n, 1))
                for c in range(len(b)):
                    S[:, c] += np.bincount(rows, weights=val * W1[c, idx], minlength=n)
                    if W2 is not None:  # sum of W2 (x - mu)^2 = that of the zeros, corrected where x is not 0
                        mu, w = W2[0][c], W2[1][c]
                        S[:, c] += np.bincount(rows, weights=w[idx] * ((val - mu[idx]) ** 2 - mu[idx] ** 2), minlength=n)
                pdf[PRED] = np.argmax(S, axis=1).astype(float)
                if mode == "softmax":
                    E_ = np.exp(S - S.max(axis=1, keepdims=True))
                    P = E_ / E_.sum(axis=1, keepdims=True)
                    pdf[PROB] = list(P)
                else:
                    pdf[PROB] = None
                yield pdf
        return base.mapInPandas(score, schema)


# ------------------------------------------------------------------ composed estimators
def fit_dummy(train: DataFrame, k: int) -> Fitted:
    """A1: most frequent class; probabilities are the class shares (ties -> smallest label)."""
    n = class_counts(train, k)
    prior = n / n.sum()
    return ScoreFitted(lambda x: lit_array(prior), is_prob=True)


def fit_nearest_centroid(train: DataFrame, k: int) -> Fitted:
    """Class means; predict the nearest (no probabilities, as the reference's model)."""
    _, mu, _ = class_stats(train, k)
    if mu.shape[1] > DENSE_EXPR_MAX_DIM:  # argmax_c 2 x.mu_c - |mu_c|^2
        return LinearScoreFitted(train.sparkSession, -(mu * mu).sum(axis=1), 2 * mu, mode="none")
    cents = [lit_array(m) for m in mu]
    return ScoreFitted(lambda x: F.array(*[-sq_dist(x, c) for c in cents]), probs=False)


def fit_gaussian_nb(train: DataFrame, k: int, var_smoothing: float = 1e-9) -> Fitted:
    """Per-class mean/population variance + epsilon * largest feature variance."""
    n, mu, var = class_stats(train, k)
    total = train.select(Summarizer.variance(F.col(FEATURES)).alias("v")).first()["v"].toArray()
    N = n.sum()
    eps = var_smoothing * float(np.max(total * (N - 1) / N)) if N > 1 else var_smoothing
    var = var + eps
    prior = np.log(n / N)
    consts = [prior[c] - 0.5 * float(np.sum(np.log(2 * math.pi * var[c]))) for c in range(k)]
    if mu.shape[1] > DENSE_EXPR_MAX_DIM:
        b = np.array([consts[c] - float(np.sum(mu[c] ** 2 / (2 * var[c]))) for c in range(k)])
        return LinearScoreFitted(train.sparkSession, b, np.zeros_like(mu), (mu, -1.0 / (2 * var)))
    terms = [(lit_array(mu[c]), lit_array(1.0 / (2 * var[c])), consts[c]) for c in range(k)]

    def score(x):
        return F.array(*[F.lit(cst) - dot(F.zip_with(x, m, lambda a, b: (a - b) * (a - b)), iv)
                         for m, iv, cst in terms])
    return ScoreFitted(score)


def fit_count_nb(train: DataFrame, k: int, alpha: float = 1.0, complement: bool = False) -> Fitted:
    """A15 multinomial / A17 complement naive Bayes from per-class feature sums (one grouped
    aggregate).  Scores are linear in x, so rows with negative values (e.g. test rows below
    the training minimum after min-max scaling) are scored, not rejected; training rows must
    be non-negative.  Complement weights are not normalised."""
    rows = (train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"),
                                     Summarizer.metrics("sum", "min").summary(F.col(FEATURES)).alias("s"))
            .collect())
    d = len(rows[0]["s"]["sum"])
    n, S = np.zeros(k), np.zeros((k, d))
    for r in rows:
        if float(r["s"]["min"].toArray().min()) < 0:
            raise ValueError("Negative values in data passed to a count naive Bayes")
        n[int(r[LABEL])] = r["n"]
        S[int(r[LABEL])] = r["s"]["sum"].toArray()
    spark = train.sparkSession
    if complement:
        comp = S.sum(axis=0, keepdims=True) - S + alpha
        W = -np.log(comp / comp.sum(axis=1, keepdims=True))
        b = np.log(np.maximum(n, 1e-300) / n.sum()) if k == 1 else np.zeros(k)
        return LinearScoreFitted(spark, b, W)
    W = np.log((S + alpha) / (S.sum(axis=1, keepdims=True) + alpha * d))
    with np.errstate(divide="ignore"):
        b = np.log(n / n.sum())
    return LinearScoreFitted(spark, b, W)


def _scatters(train: DataFrame, mu: np.ndarray, pooled: bool) -> np.ndarray:
    """Sum of (x - mu_c)(x - mu_c)^T over the rows, of all classes or of each (k x d x d).  One pass of
    Arrow batches; a batch's partial is a d x d product, added up by Summarizer."""
    from loupe.operators.reduce import sum_of_batches
    k, d = mu.shape

    def part(X, y):
        out = np.zeros((1 if pooled else k, d, d))
        Z = X - mu[y]
        for c in ([None] if pooled else np.unique(y)):
            z = Z if pooled else Z[y == c]
            out[0 if pooled else c] += z.T @ z
        return out
    return sum_of_batches(train, part, (1 if pooled else k) * d * d).reshape(-1, d, d)


def fit_lda(train: DataFrame, k: int, shrink: float = 1e-6) -> Fitted:
    """Shared covariance, linear discriminants solved on the driver, which holds a d x d matrix
    (reduce the features of very wide data first)."""
    n, mu, _ = class_stats(train, k)
    S = _scatters(train, mu, True)[0] / max(n.sum() - len(n), 1.0)
    S = S + shrink * np.trace(S) / max(len(S), 1) * np.eye(len(S)) + 1e-12 * np.eye(len(S))
    W = np.linalg.solve(S, mu.T).T  # k x d
    prior = np.log(np.maximum(n, 1e-300) / n.sum())
    b = [float(-0.5 * mu[c] @ W[c] + prior[c]) for c in range(k)]
    if W.shape[1] > DENSE_EXPR_MAX_DIM:
        return LinearScoreFitted(train.sparkSession, np.array(b), W)
    rows = [(lit_array(W[c]), b[c]) for c in range(k)]
    return ScoreFitted(lambda x: F.array(*[dot(x, w) + F.lit(bb) for w, bb in rows])).weighed(np.abs(W).sum(axis=0))


def fit_qda(train: DataFrame, k: int, reg: float = 1e-6) -> Fitted:
    """One covariance per class; score = log prior - 1/2 log|S_c| - 1/2 ||L_c (x - mu_c)||^2."""
    n, mu, _ = class_stats(train, k)
    scatters = _scatters(train, mu, False)
    parts = []
    for c in range(k):
        S = scatters[c] / max(n[c] - 1, 1.0)
        S = S + reg * (np.trace(S) / max(len(S), 1) + 1.0) * np.eye(len(S))
        inv = np.linalg.inv(S)
        L = np.linalg.cholesky(inv).T
        _, logdet = np.linalg.slogdet(S)
        parts.append((lit_array(mu[c]), F.array(*[lit_array(r) for r in L]),
                      float(math.log(max(n[c], 1e-300) / n.sum()) - 0.5 * logdet)))

    def score(x):
        out = []
        for m, L, cst in parts:
            z = F.zip_with(x, m, lambda a, b: a - b)
            y = F.transform(L, lambda row: dot(row, z))
            out.append(F.lit(cst) - 0.5 * dot(y, y))
        return F.array(*out)
    return ScoreFitted(score)


def fit_ridge(train: DataFrame, k: int, alpha: float = 1.0) -> Fitted:
    """One-vs-rest least squares on +-1 targets (L2), predict argmax; no probabilities."""
    n = train.count()
    models = []
    for c in range(k if k > 2 else 1):
        y = F.when(F.col(LABEL) == float(c if k > 2 else 1), 1.0).otherwise(-1.0)
        m = Rg.LinearRegression(featuresCol=FEATURES, labelCol="_y", regParam=alpha / max(n, 1), elasticNetParam=0.0,
                                standardization=False).fit(train.withColumn("_y", y))
        models.append((lit_array(m.coefficients.toArray()), float(m.intercept)))
        weights = np.abs(m.coefficients.toArray()) + (weights if c else 0)
    if k == 2:
        w, b = models[0]
        return ScoreFitted(lambda x: F.array(-(dot(x, w) + F.lit(b)), dot(x, w) + F.lit(b)), probs=False).weighed(weights)
    return ScoreFitted(lambda x: F.array(*[dot(x, w) + F.lit(b) for w, b in models]), probs=False).weighed(weights)


class OneVsRestProb(Fitted):
    """Per-class binary models whose positive-class probabilities are normalised."""

    def __init__(self, models: list, k: int, has_probability=True):
        self.models, self.k, self.has_probability = models, k, has_probability

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.drop(PRED, PROB)
        for c, m in enumerate(self.models):
            t = m.transform(out.select("*"))
            if self.has_probability:
                col = vector_to_array(F.col("probability"))[1]
            else:
                col = vector_to_array(F.col("rawPrediction"))[1]
            out = t.withColumn(f"_p{c}", col).drop("probability", "rawPrediction", "prediction")
        scores = F.array(*[F.col(f"_p{c}") for c in range(self.k)])
        out = out.withColumn("_s", scores).withColumn(PRED, argmax(F.col("_s")))
        if self.has_probability:
            tot = F.aggregate(F.col("_s"), F.lit(0.0), lambda a, v: a + v)
            out = out.withColumn(PROB, F.transform(F.col("_s"), lambda v: v / tot))
        else:
            out = out.withColumn(PROB, F.lit(None).cast("array<double>"))
        return out.drop("_s", *[f"_p{c}" for c in range(self.k)])


def fit_ovr(make: Callable[[], object], train: DataFrame, k: int, has_probability=True) -> Fitted:
    if k == 2:
        return SparkFitted(make().fit(train), has_probability)

    def one(c: int):
        return make().setLabelCol("_bin").fit(train.withColumn("_bin", (F.col(LABEL) == float(c)).cast("double")))

    # the classes' fits are many short jobs each and do not depend on each other
    with ThreadPool(min(k, OVR_AT_ONCE)) as pool:
        models = pool.map(inheritable_thread_target(train.sparkSession)(one), range(k))
    return OneVsRestProb(models, k, has_probability)


# ------------------------------------------------------------------ ensembles (loops of distributed fits)
class Averaged(Fitted):
    def __init__(self, members: list[Fitted], k: int, weights=None, hard: bool = False):
        self.members, self.k, self.hard = members, k, hard
        self.weights = weights or [1.0] * len(members)
        self.has_probability = not hard
        self.tag = f"_m{next(_TAGS)}_"

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.drop(PRED, PROB)
        for i, m in enumerate(self.members):
            t = m.transform(out)
            if self.hard:
                one_hot = F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)),
                                      lambda j: F.when(j == F.col(PRED).cast("int"), 1.0).otherwise(0.0))
                t = t.withColumn(f"{self.tag}{i}", one_hot)
            else:
                p = F.coalesce(F.col(PROB), F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)),
                                                         lambda j: F.when(j == F.col(PRED).cast("int"), 1.0).otherwise(0.0)))
                t = t.withColumn(f"{self.tag}{i}", p)
            out = t.drop(PRED, PROB)
        acc = None
        wsum = float(sum(self.weights))
        for i, w in enumerate(self.weights):
            term = F.transform(F.col(f"{self.tag}{i}"), lambda v: v * F.lit(w / wsum))
            acc = term if acc is None else F.zip_with(acc, term, lambda a, b: a + b)
        out = out.withColumn(self.tag + "avg", acc).withColumn(PRED, argmax(F.col(self.tag + "avg")))
        out = out.withColumn(PROB, F.col(self.tag + "avg") if not self.hard else F.lit(None).cast("array<double>"))
        return out.drop(self.tag + "avg", *[f"{self.tag}{i}" for i in range(len(self.members))])


def _with_content_key(train: DataFrame) -> DataFrame:
    """A row key for draws and folds: an earlier ``_key``, else the hash of the row's content (equal rows
    share it, so they are drawn alike and never straddle folds)."""
    if KEY in train.columns:
        return train
    return train.withColumn(KEY, F.md5(F.concat_ws("|", F.col(LABEL), F.to_json(vector_to_array(F.col(FEATURES))))))


class ForestFitted(Fitted):
    """Scores from one table of nodes (``trees.FlatForest``), in one pass of Arrow batches; the plan does not
    depend on the number of trees.  ``softmax_from``: scores to start from, of which the softmax is taken."""

    has_probability = True

    def __init__(self, spark, forest: T.FlatForest, softmax_from=None):
        self.forest, self.start = forest, softmax_from
        self.bc = spark.sparkContext.broadcast(forest)
        self.feature_weights = forest.gains

    def transform(self, df: DataFrame) -> DataFrame:
        bc, start = self.bc, self.start

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            out = bc.value.scores(np.stack(x.to_numpy()))
            if start is not None:
                out = T._softmax(out + start)
            return pd.Series(list(out))

        name = f"_f{next(_TAGS)}"
        out = df.drop(PRED, PROB).withColumn(name, scores(vector_to_array(F.col(FEATURES))))
        return out.withColumn(PRED, argmax(F.col(name))).withColumn(PROB, F.col(name)).drop(name)


class DealtForestFitted(Fitted):
    """Scores from written subtrees (``trees.DealtForest``): rows are written with a number and dealt to them."""

    def __init__(self, forest: T.DealtForest):
        self.forest, self.feature_weights = forest, forest.gains

    def transform(self, df: DataFrame) -> DataFrame:
        number, name = f"_q{next(_TAGS)}", f"_f{next(_TAGS)}"
        asked = staged(df.drop(PRED, PROB).withColumn(number, F.monotonically_increasing_id()), "asked")
        found = self.forest.scores(asked.select(F.col(number).alias("id"), vector_to_array(F.col(FEATURES)).alias("x")))
        out = asked.join(found.select(F.col("id").alias(number), F.col("p").alias(name)), number, "left").drop(number)
        return out.withColumn(PRED, argmax(F.col(name))).withColumn(PROB, F.col(name)).drop(name)


def _forest_fitted(train: DataFrame, forest: T.FlatForest | T.DealtForest) -> Fitted:
    return DealtForestFitted(forest) if isinstance(forest, T.DealtForest) else ForestFitted(train.sparkSession, forest)


def fit_random_forest(train: DataFrame, k: int, trees: int = 100, max_depth: int = TREE_DEPTH, criterion: str = "gini", seed: int = 42) -> Fitted:
    """A4: trees on bootstrap draws, the root of the number of features (rounded up) drawn at each node."""
    if criterion not in ("gini", "entropy"):
        raise ValueError("criterion is 'gini' or 'entropy'")
    data = _binned(train, k)
    share = math.ceil(math.sqrt(data.d))
    return _forest_fitted(train, T.grow_forest(data, trees, T.Bags((1.0,) * k, False, seed), share, max_depth, seed, criterion == "entropy"))


def _binned(train: DataFrame, k: int, bins: int = T.BINS) -> T.Binned:
    return T.bin_rows(_with_content_key(train), k, KEY, FEATURES, LABEL, bins)


def fit_adaboost(train: DataFrame, k: int, rounds: int = 50, seed: int = 0, undersample: bool = False) -> Fitted:
    """A7 (SAMME on stumps) and A26 (each round fitted on a balanced draw): one aggregate a round."""
    data = _binned(train, k)
    redraw = T.Bags(T.even_rates(data.counts, True), True, seed) if undersample else None
    stumps = T.boost_stumps(data, 1, rounds, redraw=redraw)
    if not len(stumps.bag):
        return fit_dummy(train, k)
    return ForestFitted(train.sparkSession, T.stump_forest(data, stumps))


def fit_bagging(train: DataFrame, k: int, n_bags: int = 10, seed: int = 0, balanced: bool = False,
                base: str = "tree", max_depth: int = TREE_DEPTH, rounds: int = EASY_ROUNDS) -> Fitted:
    """A8 bagging and A25 balanced bagging (trees on bootstrap draws, balanced by class or not), A24 balanced
    random forest (a draw of the features at each node too), A27 easy ensemble (AdaBoost on balanced draws)."""
    data = _binned(train, k)
    rates = T.even_rates(data.counts, balanced)
    if base == "ada":
        stumps = T.boost_stumps(data, n_bags, rounds, bags=T.Bags(rates, True, seed))
        if not len(stumps.bag):
            return fit_dummy(train, k)
        return ForestFitted(train.sparkSession, T.stump_forest(data, stumps))
    share = max(1, math.isqrt(data.d)) if base == "forest" else None
    return _forest_fitted(train, T.grow_forest(data, n_bags, T.Bags(rates, False, seed), share, max_depth, seed))


def fit_hist_boosting(train: DataFrame, k: int, rounds: int = T.HIST_ROUNDS, learning_rate: float = T.LEARNING_RATE,
                      max_leaves: int = T.LEAVES, min_rows: int = T.LEAST_ROWS) -> Fitted:
    """Second-order boosting of k trees a round on the softmax loss."""
    forest, start, losses = T.boost_histograms(_binned(train, k, T.HIST_BINS), rounds, learning_rate, max_leaves, min_rows)
    out = ForestFitted(train.sparkSession, forest, start)
    out.losses = losses
    return out


def fit_self_training(train: DataFrame, k: int, unlabelled: DataFrame | None = None, threshold: float = 0.75,
                      max_iter: int = 10) -> Fitted:
    """Fit, pseudo-label unlabelled rows with probability > threshold, refit (base: A2)."""
    model = fit_spark("LRN", train, k)
    if unlabelled is None:
        return model
    pool = unlabelled.drop(LABEL)
    labelled = train.select(FEATURES, LABEL)
    for _ in range(max_iter):
        scored = model.transform(pool).withColumn("_r", F.array_max(PROB))
        sure = scored.filter(F.col("_r") > threshold)
        if sure.limit(1).count() == 0:
            break
        labelled = cut_lineage(labelled.unionByName(sure.select(FEATURES, F.col(PRED).alias(LABEL))))
        pool = scored.filter(F.col("_r") <= threshold).drop(PRED, PROB, "_r")
        model = fit_spark("LRN", labelled, k)
    return model


def fit_stacking(train: DataFrame, k: int, base_codes: tuple[str, ...], folds: int = 5, seed: int = 1) -> Fitted:
    """Out-of-fold base-model probabilities -> logistic regression."""
    # written once: every base model of every fold reads the rows again, and draws by their keys
    df = staged(_with_content_key(train).withColumn("_f", F.pmod(F.xxhash64(KEY, F.lit(seed)), F.lit(folds))), "folds")
    oof_parts = []
    for f in range(folds):
        tr, te = df.filter(F.col("_f") != f), df.filter(F.col("_f") == f)
        cols = []
        piece = te
        for j, code in enumerate(base_codes):
            m = fit(code, tr.drop("_f"), k)
            piece = m.transform(piece).withColumnRenamed(PROB, f"_b{j}").drop(PRED)
            cols.append(f"_b{j}")
        oof_parts.append(piece)
    oof = oof_parts[0]
    for p in oof_parts[1:]:
        oof = oof.unionByName(p)
    meta_x = F.flatten(F.array(*[F.col(c) for c in [f"_b{j}" for j in range(len(base_codes))]]))
    meta = staged(oof.select(array_to_vector(meta_x).alias(FEATURES), LABEL), "stacked")
    meta_model = fit_spark("LRN", meta, k)
    bases = [fit(code, df.drop("_f") if KEY in train.columns else df.drop("_f", KEY), k) for code in base_codes]

    class Stacked(Fitted):
        has_probability = True

        def transform(self, d: DataFrame) -> DataFrame:
            out = d.drop(PRED, PROB)
            for j, m in enumerate(bases):
                out = m.transform(out).withColumnRenamed(PROB, f"_b{j}").drop(PRED)
            mx = F.flatten(F.array(*[F.col(f"_b{j}") for j in range(len(bases))]))
            out = out.withColumn("_orig_features", F.col(FEATURES)).withColumn(FEATURES, array_to_vector(mx))
            out = meta_model.transform(out)
            return out.withColumn(FEATURES, F.col("_orig_features")).drop(
                "_orig_features", *[f"_b{j}" for j in range(len(bases))])
    return Stacked()


# ------------------------------------------------------------------ Spark ML estimators
def _n_rows(train: DataFrame) -> int:
    return max(train.count(), 1)


#: Settings that each algorithm of ``fit_spark`` takes; another one is an error.
SETTINGS: dict[str, set[str]] = {
    "LRN": {"max_iter", "seed", "C", "tol", "class_weight"}, "DTC": {"seed", "max_depth", "criterion"}, "RFCL": {"seed", "max_depth", "trees", "criterion"},
    "GBC": {"seed", "rounds", "max_depth", "learning_rate"}, "LSVC": {"max_iter", "seed", "C", "tol", "class_weight"}, "SLSV": {"max_iter", "seed"},
    "MNB": {"seed", "alpha"}, "CNB": {"seed", "alpha"}, "BNB": {"seed", "alpha"}, "MLPC": {"seed", "hidden", "epochs"}}
SETTINGS |= {"SVC": SETTINGS["LSVC"], "MLP2": SETTINGS["MLPC"]}


def balanced_weights(train: DataFrame, k: int) -> DataFrame:
    """With a weight that gives every class the same total."""
    n = class_counts(train, k)
    each = F.lit(0.0)
    for c in range(k):
        if n[c]:
            each = F.when(F.col(LABEL) == float(c), F.lit(float(n.sum() / (np.count_nonzero(n) * n[c])))).otherwise(each)
    return train.withColumn(WEIGHT, each)


def fit_spark(code: str, train: DataFrame, k: int, max_iter: int = 100, seed: int = 42, **kw) -> Fitted:
    """An estimator of Spark ML with the settings of ``SETTINGS``.  ``C``: inverse strength of the L2 penalty on
    the summed loss; ``class_weight``: 'balanced' or None."""
    given = set(kw) | ({"max_iter"} if max_iter != 100 else set())
    if unknown := given - SETTINGS.get(code, given):
        raise ValueError(f"{code} takes no setting {', '.join(sorted(unknown))}")
    if kw.get("class_weight") not in (None, "balanced"):
        raise ValueError("class_weight is 'balanced' or None")
    L = dict(featuresCol=FEATURES, labelCol=LABEL)
    linear = L | {"maxIter": max_iter, "tol": kw.get("tol", 1e-4)}
    if code in ("LRN", "LSVC", "SVC"):
        linear["regParam"] = 1.0 / (kw.get("C", 1.0) * _n_rows(train))
        if kw.get("class_weight"):
            train = balanced_weights(train, k)
            linear["weightCol"] = WEIGHT
    if code == "LRN":
        return SparkFitted(C.LogisticRegression(**linear).fit(train))
    if code == "DTC":
        return SparkFitted(C.DecisionTreeClassifier(maxDepth=kw.get("max_depth", TREE_DEPTH), impurity=kw.get("criterion", "gini"), seed=seed, **L).fit(train))
    if code == "RFCL":
        return fit_random_forest(train, k, kw.get("trees", 100), kw.get("max_depth", TREE_DEPTH), kw.get("criterion", "gini"), seed)
    if code == "GBC":
        return fit_ovr(lambda: C.GBTClassifier(maxIter=kw.get("rounds", BOOSTING_ROUNDS), maxDepth=kw.get("max_depth", 3), stepSize=kw.get("learning_rate", 0.1), seed=seed, **L), train, k)
    if code in ("LSVC", "SVC"):
        return fit_ovr(lambda: C.LinearSVC(**linear), train, k,
                       has_probability=False)
    if code == "SLSV":
        l1 = C.LogisticRegression(maxIter=max_iter, regParam=0.01, elasticNetParam=1.0, **L).fit(train)
        coef = l1.coefficientMatrix.toArray()
        keep = [int(i) for i in np.where(np.abs(coef).sum(axis=0) > 0)[0]] or list(range(coef.shape[1]))
        slicer = VectorSlicer(inputCol=FEATURES, outputCol="_sliced", indices=keep)
        inner = fit_ovr(lambda: C.LinearSVC(featuresCol="_sliced", labelCol=LABEL, maxIter=max_iter,
                                            regParam=1.0 / _n_rows(train)),
                        slicer.transform(train), k, has_probability=False)

        class Sliced(Fitted):
            has_probability = False

            def transform(self, d):
                return inner.transform(slicer.transform(d)).drop("_sliced")
        return Sliced()
    if code in ("MNB", "CNB"):
        return fit_count_nb(train, k, kw.get("alpha", 1.0), complement=(code == "CNB"))
    if code == "BNB":
        b = Binarizer(threshold=0.0, inputCol=FEATURES, outputCol="_bin_features")
        m = C.NaiveBayes(modelType="bernoulli", smoothing=kw.get("alpha", 1.0), featuresCol="_bin_features", labelCol=LABEL).fit(
            b.transform(train))

        class Bern(Fitted):
            has_probability = True
            feature_weights = np.abs(m.theta.toArray() - m.theta.toArray().mean(axis=0)).sum(axis=0)

            def transform(self, d):
                return SparkFitted(m).transform(b.transform(d)).drop("_bin_features")
        return Bern()
    if code in ("MLPC", "MLP2"):
        d = feature_dim(train)
        hidden = kw.get("hidden", HIDDEN_LIGHT if code == "MLP2" else HIDDEN)
        return SparkFitted(C.MultilayerPerceptronClassifier(layers=[d, *hidden, k], maxIter=kw.get("epochs", 200),
                                                            seed=seed, **L).fit(train))
    raise KeyError(code)


@dataclass(frozen=True)
class AlgorithmInfo:
    code: str
    name: str
    rfe_compatible: bool
    needs_nonnegative: bool = False
    kind: str = "B"


# The algorithm codes, names and RFE compatibility flags.
ALGORITHMS: dict[str, AlgorithmInfo] = {a.code: a for a in [
    AlgorithmInfo("DUMY", "Dummy Classifier", False, kind="C"),
    AlgorithmInfo("SRF1", "Stacked Random Forests 1", False, kind="I"),
    AlgorithmInfo("BARF", "Balanced Random Forest", True, kind="I"),
    AlgorithmInfo("BABC", "Balanced Bagging Classifier", False, kind="I"),
    AlgorithmInfo("RUBC", "RUS Boost Classifier", True, kind="I"),
    AlgorithmInfo("EAEC", "Easy Ensamble Classifier", False, kind="I"),
    AlgorithmInfo("LRN", "Logistic Regression", True),
    AlgorithmInfo("KNN", "K-Neighbors Classifier", False, kind="C"),
    AlgorithmInfo("RADN", "Radius Neighbors Classifier", False, kind="C"),
    AlgorithmInfo("DTC", "Decision Tree Classifier", True),
    AlgorithmInfo("GNB", "Gaussian Naive Bayes", False, kind="C"),
    AlgorithmInfo("MNB", "Multinomial Naive Bayes", True, needs_nonnegative=True),
    AlgorithmInfo("BNB", "Bernoulli Naive Bayes", True),
    AlgorithmInfo("CNB", "Complement Naive Bayes", True, needs_nonnegative=True),
    AlgorithmInfo("REC", "Ridge Classifier", True, kind="C"),
    AlgorithmInfo("RFCL", "Random Forest Classifier", True),
    AlgorithmInfo("LSVC", "Linear Support Vector", True),
    AlgorithmInfo("SLSV", "Stacked Linear SVC", False, kind="C"),
    AlgorithmInfo("SGDE", "Stochastic Gradient Descent", True),
    AlgorithmInfo("NCT", "Nearest Centroid", False, kind="C"),
    AlgorithmInfo("SVC", "Support Vector Classification", False),
    AlgorithmInfo("STCL", "Self Training Classifier", False, kind="I"),
    AlgorithmInfo("LDA", "Linear Discriminant Analysis", True, kind="C"),
    AlgorithmInfo("QDA", "Quadratic Discriminant Analysis", False, kind="C"),
    AlgorithmInfo("BGC", "Bagging Classifier", False, kind="I"),
    AlgorithmInfo("ABC", "Ada Boost Classifier", True, kind="I"),
    AlgorithmInfo("GBC", "Gradient Boosting Classifier", True),
    AlgorithmInfo("HIST", "Histogram-based Gradient B. Classifier", False),
    AlgorithmInfo("MLPC", "Multi Layered Peceptron", False),
    AlgorithmInfo("MLP2", "Multi Layered Peceptron Light", False),
    AlgorithmInfo("VOTG", "Voting Classifier", False, kind="C"),
    AlgorithmInfo("FUTV", "FUT Voting Classifier", False, kind="C"),
    AlgorithmInfo("FUTS", "FUT Stacking Classifier", False, kind="I"),
    AlgorithmInfo("PYNN", "Feed-forward network", False),
]}


def fit(code: str, train: DataFrame, k: int, **kw) -> Fitted:
    """Fit algorithm ``code`` on a frame with ``features`` and ``label_idx``."""
    composed = {
        "DUMY": fit_dummy, "NCT": fit_nearest_centroid, "GNB": fit_gaussian_nb, "LDA": fit_lda, "QDA": fit_qda,
        "REC": fit_ridge,
        "HIST": fit_hist_boosting, "SGDE": fit_sgd,
        "ABC": lambda t, kk, **a: fit_adaboost(t, kk, **a),
        "RUBC": lambda t, kk, **a: fit_adaboost(t, kk, undersample=True, **a),
        "BGC": lambda t, kk, **a: fit_bagging(t, kk, **a),
        "BABC": lambda t, kk, **a: fit_bagging(t, kk, balanced=True, **a),
        "BARF": lambda t, kk, **a: fit_bagging(t, kk, balanced=True, base="forest", **({"n_bags": 100} | a)),
        "EAEC": lambda t, kk, **a: fit_bagging(t, kk, balanced=True, base="ada", **a),
        "STCL": fit_self_training,
        "SRF1": lambda t, kk, **a: fit_stacking(t, kk, ("RFCL", "BARF"), **a),
        "FUTS": lambda t, kk, **a: fit_stacking(t, kk, ("MLPC", "RFCL", "ABC"), **a),
        "VOTG": lambda t, kk, **a: Averaged([fit("LSVC", t, kk), fit("RFCL", t, kk), fit("LRN", t, kk)], kk, hard=True),
        "FUTV": lambda t, kk, **a: Averaged([fit("MLPC", t, kk), fit("RFCL", t, kk), fit("ABC", t, kk)], kk),
    }
    if code in ("KNN", "RADN"):
        from loupe.operators.knn import fit_knn_classifier
        return fit_knn_classifier(train, k, radius=(code == "RADN"), **kw)
    if code in NETWORKS:
        return fit_network(train, k, **NETWORKS[code] | kw)
    if code in composed:
        return composed[code](train, k, **kw)
    return fit_spark(code, train, k, **kw)
