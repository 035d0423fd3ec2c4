"""Tree ensembles on binned features: many trees grown together, scored from one node table.

Features are cut into bins once and every row becomes a short byte string.  What a row weighs in a
member (bootstrap counts, balanced draws, boosting weights) is a function of its key hash, its class
and the trees so far, so nothing is rewritten between rounds and plans do not grow.

* Forests: large nodes of all members are split level by level from class-by-bin histograms that are
  summed and searched in groups of one node; a node of at most ``FINISH`` rows is finished in one group,
  where nodes of few rows are searched by ordered rows.  Rows travel packed, many of a group in one row.
  Trees without a depth limit have nodes in proportion to the rows, so the subtrees of those groups are
  written as a table, and rows that are scored are dealt to them (:class:`DealtForest`); the driver holds
  the nodes above.  A forest of at most ``NODES_MOST`` nodes is one :class:`FlatForest`.
* AdaBoost: one grouped aggregate a round for all bags finds the best stump of every feature block.
* Histogram boosting: gradient and Hessian histograms of the k trees of a round; of two siblings the
  smaller is counted, the other is their parent less it, and what a leaf adds follows from its parent's.
  The raw scores are kept between rounds.  A table of at most ``SMALL`` rows grows each tree in one
  group, by the same rule.

Other fitted ensembles are a :class:`FlatForest`, arrays of nodes that score a batch in one pass; the plan
does not depend on the number of members.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.session import staged

BINS, HIST_BINS = 32, 64
#: Rows of a table whose boosted trees grow in one group each.
SMALL = 4096
#: Rows of a forest's node that one group finishes; nodes of a forest that the driver holds at most.
FINISH, NODES_MOST = 1 << 16, 1 << 17
#: Cells of histograms that a group holds at once; rows that a group scores by a subtree.
CELLS, SCORED = 1 << 20, 1 << 16
#: Numbers that a group sums to the scores of its rows.
SUMMED = 1 << 22
#: Bits of a bin, a class and a weight of a row in the order of its node.
BIN_BITS, CLASS_BITS, WEIGHT_BITS = 5, 10, 6
#: A class share in the sums of written subtrees, which do not depend on the order of arrival.
UNIT = 1 << 40
#: Bytes of histograms that a task holds; features of a group of stump histograms.
HELD, BLOCK = 1 << 26, 64
LEAF = -1
# The defaults of histogram boosting.
LEARNING_RATE, LEAVES, LEAST_ROWS, HIST_ROUNDS = 0.1, 31, 20, 100
#: Rounds of boosting between two written tables of raw scores.
REWRITE = 10


# ---------------------------------------------------------------- bins

@dataclass
class Binned:
    """rows: (h: hash of the key, y: class, bins: a byte a feature); edges: of each feature, ascending.  A
    value in bin b is at most edges[b] and over edges[b - 1]."""

    rows: DataFrame
    edges: list[np.ndarray]
    k: int
    counts: np.ndarray

    @property
    def d(self) -> int:
        return len(self.edges)


def bin_edges(train: DataFrame, features: str, bins: int) -> list[np.ndarray]:
    """Quantile edges of every feature (one grouped sketch); the largest value is no edge."""
    probs = [F.lit(i / bins) for i in range(1, bins)]
    cells = train.select(F.posexplode(vector_to_array(F.col(features))).alias("j", "v"))
    found = cells.groupBy("j").agg(F.percentile_approx("v", F.array(*probs), F.lit(10000)).alias("q"), F.max("v").alias("top")).collect()  # a row a feature
    out = [np.zeros(0)] * len(found)
    for r in found:
        q = np.unique(np.array(r["q"], float))
        out[r["j"]] = q[q < r["top"]]
    return out


def bin_rows(train: DataFrame, k: int, key: str, features: str = "features", label: str = "label_idx", bins: int = BINS) -> Binned:
    """Bin ``train`` and write the rows; ``key`` names a row in the draws of bags."""
    edges = bin_edges(train, features, bins)

    @F.pandas_udf("binary")
    def binned(x: pd.Series) -> pd.Series:
        X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(edges)))
        return pd.Series([r.tobytes() for r in binned_rows(X, edges)], dtype=object)

    rows = train.select(F.xxhash64(F.col(key)).alias("h"), F.col(label).cast("int").alias("y"), binned(vector_to_array(F.col(features))).alias("bins"))
    rows = staged(rows, "binned")
    counts = np.zeros(k)
    for r in rows.groupBy("y").count().collect():
        counts[r["y"]] = r["count"]
    return Binned(rows, edges, k, counts)


def _batch(pdf: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    X = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), d)
    return X, pdf["y"].to_numpy(np.int64), pdf["h"].to_numpy(np.int64).view(np.uint64)


def uniforms(h: np.ndarray, salt: int) -> np.ndarray:
    """A draw in [0, 1) for each key hash."""
    x = h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).astype(np.float64) / 2.0**64


@dataclass(frozen=True)
class Bags:
    """How often a row is in a bag: Poisson draws with the rate of its class (a bootstrap), or, with
    ``once``, at most once with that probability."""

    rates: tuple[float, ...]
    once: bool
    seed: int

    def draw(self, h: np.ndarray, y: np.ndarray, bag: int) -> np.ndarray:
        u, rate = uniforms(h, 1 + self.seed * 1_000_003 + bag), np.asarray(self.rates)[y]
        if self.once:
            return (u < rate).astype(float)
        out, p = np.zeros(len(u)), np.exp(-rate)
        total, i = p.copy(), 0
        while (more := u >= total).any() and i < 40:
            i += 1
            out[more] += 1
            p = p * rate / i
            total = total + p
        return out


def even_rates(counts: np.ndarray, balanced: bool) -> tuple[float, ...]:
    """1 for every class, or the share that leaves each as many rows as the smallest has."""
    some = counts[counts > 0]
    return tuple(float(min(1.0, some.min() / c)) if balanced and c else 1.0 for c in counts)


# ---------------------------------------------------------------- the node table

@dataclass
class FlatForest:
    """Nodes of all trees: feature (LEAF: none), threshold and its bin, children, and what a row that ends
    there adds to the scores."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    gains: np.ndarray

    def ends(self, X: np.ndarray, trees: np.ndarray, binned: bool) -> np.ndarray:
        """Node at which each row ends in each of ``trees`` (rows x trees)."""
        bound = self.cut if binned else self.threshold
        at = np.tile(self.roots[trees], (len(X), 1))
        rows = np.arange(len(X))[:, None]
        while True:
            f = self.feature[at]
            inner = f != LEAF
            if not inner.any():
                return at
            low = X[rows, np.where(inner, f, 0)] <= bound[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)

    def end(self, X: np.ndarray, tree: int) -> np.ndarray:
        """Node at which each binned row ends in one tree."""
        at = np.full(len(X), self.roots[tree])
        open_ = np.arange(len(X))
        while len(open_ := open_[self.feature[at[open_]] != LEAF]):
            node = at[open_]
            at[open_] = np.where(X[open_, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return at

    def scores(self, X: np.ndarray, binned: bool = False) -> np.ndarray:
        """Sums of the values over all trees, some trees at a time."""
        out = np.zeros((len(X), self.value.shape[1]))
        step = max(1, (1 << 20) // max(1, len(X)))
        for t in range(0, len(self.roots), step):
            for node in self.ends(X, np.arange(t, min(t + step, len(self.roots))), binned).T:
                out += self.value[node]
        return out


class Growing:
    """Trees under construction, as lists of nodes."""

    def __init__(self, k: int, edges: list[np.ndarray]):
        self.k, self.edges = k, edges
        self.feature, self.cut, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        self.gains = np.zeros(len(edges))

    def node(self, value) -> int:
        self.feature.append(LEAF)
        self.cut.append(0)
        self.left.append(0)
        self.right.append(0)
        self.value.append(value)
        return len(self.feature) - 1

    def split(self, at: int, feature: int, cut: int, gain: float, left, right) -> tuple[int, int]:
        self.feature[at], self.cut[at] = int(feature), int(cut)
        self.left[at], self.right[at] = self.node(left), self.node(right)
        self.gains[feature] += gain
        return self.left[at], self.right[at]

    def flat(self, to_value=lambda v: v) -> FlatForest:
        feature, cut = np.array(self.feature, np.int64), np.array(self.cut, np.int64)
        threshold = np.array([self.edges[f][c] if f != LEAF else 0.0 for f, c in zip(self.feature, self.cut)])
        value = np.array([to_value(np.asarray(v, float)) for v in self.value]).reshape(len(feature), self.k)
        return FlatForest(feature, cut, threshold, np.array(self.left, np.int64), np.array(self.right, np.int64), value, np.array(self.roots, np.int64), self.gains)


# ---------------------------------------------------------------- class histograms

def class_histogram(X: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, bins: int) -> np.ndarray:
    """Weights by (feature, bin, class)."""
    m = X.shape[1]
    code = ((np.arange(m) * bins + X) * k + y[:, None]).ravel()
    return np.bincount(code, weights=np.repeat(w, m), minlength=m * bins * k).reshape(m, bins, k)


def best_class_splits(hist: np.ndarray, entropy: bool = False) -> tuple[np.ndarray, ...]:
    """For histograms by (node, feature, bin, class): feature, bin, gain, left and right class weights of the
    largest decrease of Gini impurity (or entropy), the first of equal ones; feature -1 if no split lowers it."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist[:, :1].sum(axis=2, keepdims=True)
    right = total - left
    n_left, n_right = left.sum(axis=3), right.sum(axis=3)

    def purity(part, n):
        if entropy:
            return (part * np.log(np.maximum(part, 1e-300))).sum(axis=-1) - n * np.log(np.maximum(n, 1e-300))
        return np.divide((part * part).sum(axis=-1), n, out=np.zeros_like(n), where=n > 1e-12)

    whole = total[:, 0, 0]
    n = whole.sum(axis=1)
    before = purity(whole, n) if entropy else (whole * whole).sum(axis=1) / np.maximum(n, 1e-300)
    gain = purity(left, n_left) + purity(right, n_right) - before[:, None, None]
    gain = np.where((n_left > 1e-12) & (n_right > 1e-12), gain, -1.0).reshape(len(hist), -1)
    if not gain.shape[1]:
        return np.full(len(hist), -1), np.zeros(len(hist), int), np.zeros(len(hist)), whole, whole
    at, node = gain.argmax(axis=1), np.arange(len(hist))
    best = gain[node, at]
    j, b = np.divmod(at, left.shape[2])
    good = best > 1e-9 * np.maximum(n, 1e-300)
    left, right = left[node, j, b], right[node, j, b]
    return np.where(good, j, -1), np.where(good, b, 0), np.where(good, best, 0.0), np.where(good[:, None], left, whole), np.where(good[:, None], right, whole)


def best_class_split(hist: np.ndarray, entropy: bool = False) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """``best_class_splits`` of one node."""
    j, b, gain, left, right = best_class_splits(hist[None], entropy)
    return int(j[0]), int(b[0]), float(gain[0]), left[0], right[0]


def feature_subsets(d: int, share: int | None, seed: int, tree: int, paths: np.ndarray) -> np.ndarray:
    """The features that each node looks at, a row a path: ``share`` of them by a draw, or all."""
    if share is None or share >= d:
        return np.tile(np.arange(d), (len(paths), 1))
    salt = (np.asarray(paths, np.uint64) + np.uint64(((seed * 1_000_003 + tree) * 1_000_003 + 7) % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
    u = uniforms(np.arange(d).astype(np.uint64) + salt[:, None], 0)
    return np.sort(np.argsort(u, axis=1, kind="stable")[:, :share], axis=1)


def feature_subset(d: int, share: int | None, seed: int, tree: int, path: int) -> np.ndarray:
    """``feature_subsets`` of one node."""
    return feature_subsets(d, share, seed, tree, np.array([path]))[0]


def _node_splits(X: np.ndarray, y: np.ndarray, w: np.ndarray, slot: np.ndarray, cols: np.ndarray, k: int, bins: int, entropy: bool) -> tuple[np.ndarray, ...]:
    """(feature, bin, gain) of the best split of each node.  Row i lies in node ``slot[i]``, rows sorted by it;
    ``cols``: the features that each node looks at.  Nodes of few rows are searched without class histograms, by
    the same sums: they are whole numbers, so both ways give the same splits."""
    n, m = cols.shape
    size = np.bincount(slot, minlength=n)
    by_order = not entropy and k <= 1 << CLASS_BITS and bins <= 1 << BIN_BITS and len(w) > 0 and w.max() < 1 << WEIGHT_BITS and (w == np.floor(w)).all()
    few = size <= (bins * k // 2 if by_order else -1)
    feature, cut, gain = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
    for mine, search, cells in ((few, _splits_by_order, 8 * m * bins), (~few, _splits_by_histogram, m * bins * k)):
        nodes = np.flatnonzero(mine)
        step, first = max(1, CELLS // cells), np.concatenate([[0], np.cumsum(size)])
        for lo in range(0, len(nodes), step):
            some = nodes[lo:lo + step]
            own = np.repeat(np.arange(len(some)), size[some])
            rows = np.arange(len(own)) + np.repeat(first[some] - np.cumsum(size[some]) + size[some], size[some])
            values = X[rows[:, None], cols[some][own]]
            j, cut[some], gain[some] = search(values, y[rows], w[rows], own, len(some), k, bins, entropy)
            feature[some] = np.where(j >= 0, cols[some, np.maximum(j, 0)], -1)
    return feature, cut, gain


def _splits_by_histogram(values: np.ndarray, y: np.ndarray, w: np.ndarray, slot: np.ndarray, n: int, k: int, bins: int, entropy: bool) -> tuple[np.ndarray, ...]:
    m = values.shape[1]
    code = ((slot[:, None] * m + np.arange(m)) * bins + values) * k + y[:, None]
    hist = np.bincount(code.ravel(), weights=np.repeat(w, m), minlength=n * m * bins * k).reshape(n, m, bins, k)
    return best_class_splits(hist, entropy)[:3]


def _splits_by_order(values: np.ndarray, y: np.ndarray, w: np.ndarray, slot: np.ndarray, n: int, k: int, bins: int, entropy: bool) -> tuple[np.ndarray, ...]:
    """``best_class_splits`` by Gini impurity.  Rows of a node and class are ordered by value, so the sum of the
    squared class weights up to a bin is a sum over rows: one of weight w after L of its class adds w (2 L + w)."""
    m, low = values.shape[1], BIN_BITS + WEIGHT_BITS
    key = ((slot << CLASS_BITS | y) << low | w.astype(np.int64)) + (values.T.astype(np.int64) << WEIGHT_BITS)
    key.sort(axis=1)  # a row a feature; node and class of a place are the same in all
    group = key[0] >> low
    own = group >> CLASS_BITS
    weight = (key & (1 << WEIGHT_BITS) - 1).astype(float)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(starts, append=len(group))
    of_class = np.add.reduceat(weight[0], starts)  # of a node and class
    before = np.repeat(np.cumsum(of_class) - of_class, size)
    square = weight * (2 * (np.cumsum(weight, axis=1) - before) - weight)
    code = ((own * m + np.arange(m)[:, None]) * bins + (key >> WEIGHT_BITS & (1 << BIN_BITS) - 1)).ravel()
    n_left, left, right = (np.cumsum(np.bincount(code, weights=x.ravel(), minlength=n * m * bins).reshape(n, m, bins), axis=2)[:, :, :-1]
                           for x in (weight, square, square - 2 * weight * np.repeat(of_class, size)))
    node = own[starts]
    total, whole = np.bincount(node, weights=of_class, minlength=n), np.bincount(node, weights=of_class * of_class, minlength=n)
    n_right, right = total[:, None, None] - n_left, right + whole[:, None, None]
    inner = (n_left > 1e-12) & (n_right > 1e-12)
    gain = np.divide(left, n_left, out=np.zeros_like(left), where=inner) + np.divide(right, n_right, out=np.zeros_like(left), where=inner) - (whole / np.maximum(total, 1e-300))[:, None, None]
    gain = np.where(inner, gain, -1.0).reshape(n, -1)
    if not gain.shape[1]:
        return np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
    at = gain.argmax(axis=1)
    best = gain[np.arange(n), at]
    j, b = np.divmod(at, bins - 1)
    good = best > 1e-9 * np.maximum(total, 1e-300)
    return np.where(good, j, -1), np.where(good, b, 0), np.where(good, best, 0.0)


def local_tree(X: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, bins: int, share: int | None, seed: int, tree: int, path: int, depth: int,
               entropy: bool = False) -> tuple[np.ndarray, ...]:
    """(feature, bin, left child, gain, class weights) of the nodes of a whole subtree, the root first, level by
    level; the right child follows the left."""
    d = X.shape[1]
    feature, cut, left, gain, weights, made = [], [], [], [], [], 1
    slot, paths = np.zeros(len(y), np.int64), np.array([path], np.int64)
    while len(paths):
        n = len(paths)
        held = np.bincount(slot * k + y, weights=w, minlength=n * k).reshape(n, k)
        j, b, g, kids = np.full(n, LEAF), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        open_ = np.flatnonzero((held > 0).sum(axis=1) > 1) if depth > 0 else np.zeros(0, np.int64)
        cols = feature_subsets(d, share, seed, tree, paths[open_]) if len(open_) else None
        while len(open_):
            place = np.full(n, -1)
            place[open_] = np.arange(len(open_))
            rows = np.flatnonzero(place[slot] >= 0)
            j[open_], b[open_], g[open_] = _node_splits(X[rows], y[rows], w[rows], place[slot[rows]], cols, k, bins, entropy)
            # none of their features parts these nodes: look at all
            open_ = open_[j[open_] < 0] if cols.shape[1] < d else open_[:0]
            cols = np.tile(np.arange(d), (len(open_), 1))
        inner = np.flatnonzero(j >= 0)
        kids[inner] = made + 2 * np.arange(len(inner))
        made += 2 * len(inner)
        for out, new in zip((feature, cut, left, gain, weights), (j, b, kids, g, held)):
            out.append(new)
        place = np.full(n, -1)
        place[inner] = np.arange(len(inner))
        rows = np.flatnonzero(place[slot] >= 0)
        high = X[rows, j[slot[rows]]] > b[slot[rows]]
        child = 2 * place[slot[rows]] + high
        order = np.argsort(child, kind="stable")
        X, y, w, slot = X[rows[order]], y[rows[order]], w[rows[order]], child[order]
        paths = ((2 * paths[inner])[:, None] + np.arange(2)).ravel() % 2**40
        depth -= 1
    return tuple(np.concatenate(x) for x in (feature, cut, left, gain, weights))


# ---------------------------------------------------------------- forests

@dataclass
class DealtForest:
    """The nodes of a forest down to written subtrees.  ``parts``: (node, and arrays as bytes: feature, cut, left
    child or the number of the leaf, class shares of the leaves), a row for every end of ``top``."""

    top: FlatForest
    parts: DataFrame
    edges: list[np.ndarray]
    k: int

    @property
    def gains(self) -> np.ndarray:
        return self.top.gains

    def scores(self, rows: DataFrame) -> DataFrame:
        """(id, p: mean class shares) of rows(id, x).  A row goes to the subtree it reaches in each tree; many
        rows of one subtree are split into parts by hash."""
        top, edges, k, n_trees = self.top, self.edges, self.k, len(self.top.roots)
        n_parts = max(1, -(-rows.count() // SCORED))
        n_sums = n_parts * max(1, SCORED * n_trees * (k + 1) // SUMMED)

        def place(ids, n):
            return np.minimum(uniforms(ids.view(np.uint64), 0) * n, n - 1).astype(np.int64)

        def deal(batches):
            packs = Packs("code", "ids", "bins")
            for pdf in batches:
                if not len(pdf):
                    continue
                X, ids = binned_rows(np.stack(pdf["x"].to_numpy()), edges), pdf["id"].to_numpy(np.int64)
                part = place(ids, n_parts)
                for t in range(n_trees):
                    yield from packs.add(top.end(X, t) * n_parts + part, ids, X)
            yield packs.taken()

        def score(key, asked, part):
            if not len(asked) or not len(part):
                return pd.DataFrame({"bucket": pd.Series([], dtype="int64"), "ids": [], "v": []})
            ids, X = np.frombuffer(b"".join(asked["ids"]), np.int64), np.frombuffer(b"".join(asked["bins"]), np.uint8).reshape(-1, len(edges))
            feature, cut, left = (np.frombuffer(part[c].iloc[0], t) for c, t in (("feature", np.int16), ("cut", np.uint8), ("left", np.int32)))
            at, open_ = np.zeros(len(X), np.int64), np.arange(len(X))
            while len(open_ := open_[feature[at[open_]] != LEAF]):
                node = at[open_]
                at[open_] = left[node] + (X[open_, feature[node]] > cut[node])
            shares = np.frombuffer(part["value"].iloc[0]).reshape(-1, k)[left[at]]
            packs = Packs("bucket", "ids", "v")
            packs.hold(place(ids, n_sums), ids, np.rint(shares * UNIT).astype(np.int64))
            return packs.taken()

        def sums(pdf):
            ids, v = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("ids", "v"))
            order = np.argsort(ids, kind="stable")
            starts = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
            total = np.add.reduceat(v.reshape(-1, k)[order], starts, axis=0)
            return pd.DataFrame({"id": ids[order][starts], "p": list(total / float(UNIT * n_trees))})

        dealt = rows.mapInPandas(deal, "code long, ids binary, bins binary")
        held = self.parts.select(F.explode(F.sequence(F.col("node") * n_parts, F.col("node") * n_parts + (n_parts - 1))).alias("code"), "feature", "cut", "left", "value")
        found = dealt.groupBy("code").cogroup(held.groupBy("code")).applyInPandas(score, "bucket long, ids binary, v binary")
        return found.groupBy("bucket").applyInPandas(sums, "id long, p array<double>")


class Packs:
    """Columns of rows that go to one group, as bytes: a row a group and some tens of megabytes."""

    def __init__(self, key: str, *columns: str):
        self.names, self.held, self.size = (key, *columns), {}, 0

    def hold(self, key: np.ndarray, *columns: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        key, columns = key[order], [x[order] for x in columns]
        cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            self.held.setdefault(int(key[lo]), []).append([x[lo:hi].tobytes() for x in columns])
        self.size += sum(x.nbytes for x in columns)

    def add(self, key: np.ndarray, *columns: np.ndarray):
        """Hold the rows; yields a table if there is much."""
        self.hold(key, *columns)
        if self.size > HELD >> 2:
            yield self.taken()

    def taken(self) -> pd.DataFrame:
        out = [(key, *map(b"".join, zip(*parts))) for key, parts in self.held.items()]
        self.held, self.size = {}, 0
        return pd.DataFrame(out, columns=self.names)


def binned_rows(X: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of every value."""
    out = np.zeros(X.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, X[:, j], side="left")
    return out


def grow_forest(data: Binned, n_trees: int, bags: Bags, share: int | None = None, depth: int = 30, seed: int = 0,
                entropy: bool = False) -> FlatForest | DealtForest:
    """``n_trees`` trees by Gini impurity or entropy, each on its own bag; a leaf's value is its class shares /
    ``n_trees``."""
    d, k, bins = data.d, data.k, BINS
    grown = Growing(k, data.edges)
    expected = data.counts * np.asarray(bags.rates)
    large: dict[int, tuple[int, int, int]] = {}  # open node -> (tree, path, depth left)
    small: dict[int, tuple[int, int, int]] = {}

    def opened(node: int, tree: int, path: int, left: int, weights) -> None:
        if left and (np.asarray(weights) > 0).sum() > 1:
            (large if np.sum(weights) > FINISH else small)[node] = (tree, path, left)

    for t in range(n_trees):
        grown.roots.append(grown.node(expected))
        opened(grown.roots[-1], t, 1, depth, expected)
    while large:
        splits = _split_level(data, grown.flat(), large, bags, share, seed, entropy)
        stuck = {n: large[n] for n, split in splits.items() if split[0] < 0} if share is not None and share < d else {}
        if stuck:  # none of their features parts these nodes: look at all
            splits |= _split_level(data, grown.flat(), stuck, bags, None, seed, entropy)
        for node, (feature, cut, gain, a, b) in splits.items():
            tree, path, left = large[node]
            if feature >= 0:
                kids = grown.split(node, feature, cut, gain, a, b)
                for kid, weights, side in zip(kids, (a, b), (0, 1)):
                    opened(kid, tree, (2 * path + side) % 2**40, left - 1, weights)
            del large[node]

    def shares(weights: np.ndarray) -> np.ndarray:
        total = weights.sum()
        return (weights / total if total > 0 else np.full(k, 1.0 / k)) / n_trees
    top = grown.flat(shares)
    parts = _finish(data, grown, small, bags, share, seed, entropy)
    sizes = parts.select("node", "n", "gains").toArrow() if small else None  # a row a subtree
    n_nodes = len(top.feature) + (sum(sizes["n"].to_pylist()) if small else 0)
    if small:
        top.gains = top.gains + np.sum(sizes["gains"].to_pylist(), axis=0)
    return _flat(top, parts, data.edges, k, n_trees) if n_nodes <= NODES_MOST else DealtForest(top, parts, data.edges, k)


def _flat(top: FlatForest, parts: DataFrame, edges: list[np.ndarray], k: int, n_trees: int) -> FlatForest:
    """One table of all nodes of a forest."""
    cols = {f: [getattr(top, f)] for f in ("feature", "cut", "threshold", "left", "right", "value")}
    made, roots = len(top.feature), {}
    for r in sorted(parts.drop("gains").toArrow().to_pylist(), key=lambda r: r["node"]):
        feature, cut, left = (np.frombuffer(r[c], t).astype(np.int64) for c, t in (("feature", np.int16), ("cut", np.uint8), ("left", np.int32)))
        inner, held = feature != LEAF, np.zeros((len(feature), k))
        held[~inner] = np.frombuffer(r["value"]).reshape(-1, k)[left[~inner]] / n_trees
        left = np.where(inner, left + made - 1, 0)
        new = {"feature": feature, "cut": cut, "threshold": np.array([edges[f][c] if f != LEAF else 0.0 for f, c in zip(feature, cut)]),
               "left": left, "right": np.where(inner, left + 1, 0), "value": held}
        for f, v in new.items():  # the root's place is in ``top``
            cols[f][0][r["node"]] = v[0]
            cols[f].append(v[1:])
        made += len(feature) - 1
    return FlatForest(**{f: np.concatenate(v) for f, v in cols.items()}, roots=top.roots, gains=top.gains)


def _split_level(data: Binned, forest: FlatForest, open_: dict, bags: Bags, share: int | None, seed: int, entropy: bool = False) -> dict:
    """The best split of every open node: histograms of a task's rows, summed and searched by node."""
    d, k, bins = data.d, data.k, BINS
    m = d if share is None else min(share, d)
    most = max(1, HELD // (m * bins * k * 8))
    nodes = sorted(open_)
    out = {}
    for lo in range(0, len(nodes), most):
        part = nodes[lo:lo + most]
        cols = {n: feature_subset(d, share, seed, open_[n][0], open_[n][1]) for n in part}
        by_tree: dict[int, list[int]] = {}
        for n in part:
            by_tree.setdefault(open_[n][0], []).append(n)

        def histograms(batches, by_tree=by_tree, cols=cols):
            held: dict[int, np.ndarray] = {}
            for pdf in batches:
                X, y, h = _batch(pdf, d)
                for tree, mine in by_tree.items():
                    w = bags.draw(h, y, tree)
                    rows = np.flatnonzero(w > 0)
                    at = forest.end(X[rows], tree)
                    order = np.argsort(at, kind="stable")
                    rows, at = rows[order], at[order]
                    for n, lo, hi in zip(mine, *(np.searchsorted(at, mine, side) for side in ("left", "right"))):
                        if hi > lo:
                            some = rows[lo:hi]
                            found = class_histogram(X[np.ix_(some, cols[n])], y[some], w[some], k, bins)
                            held[n] = held[n] + found if n in held else found
            for n, hist in held.items():
                yield pd.DataFrame({"node": [n], "hist": [hist.ravel()]})

        def search(pdf):
            n = int(pdf["node"].iloc[0])
            j, b, gain, left, right = best_class_split(sum(pdf["hist"]).reshape(-1, bins, k), entropy)
            return pd.DataFrame({"node": [n], "feature": [int(cols[n][j]) if j >= 0 else -1], "cut": [b], "gain": [gain], "a": [left], "b": [right]})

        found = data.rows.mapInPandas(histograms, "node long, hist array<double>").groupBy("node").applyInPandas(
            search, "node long, feature int, cut int, gain double, a array<double>, b array<double>").collect()  # a row a node
        out |= {r["node"]: (r["feature"], r["cut"], r["gain"], np.array(r["a"]), np.array(r["b"])) for r in found}
    return out


def _finish(data: Binned, grown: Growing, small: dict, bags: Bags, share: int | None, seed: int, entropy: bool = False) -> DataFrame:
    """The subtrees under all nodes of at most FINISH rows, one group each, as a written table; a leaf above them
    is a subtree of one node.  Nothing in proportion to the rows comes to the driver."""
    d, k = data.d, data.k
    schema = "node long, n long, feature binary, cut binary, left binary, value binary, gains array<double>"
    forest = grown.flat()
    trees = sorted({t for t, _, _ in small.values()})
    is_open = np.zeros(len(forest.feature), bool)
    is_open[list(small)] = True

    def deal(batches):
        packs = Packs("node", "y", "w", "bins")
        for pdf in batches:
            X, y, h = _batch(pdf, d)
            for tree in trees:
                w = bags.draw(h, y, tree)
                rows = np.flatnonzero(w > 0)
                at = forest.end(X[rows], tree)
                rows, at = rows[is_open[at]], at[is_open[at]]
                yield from packs.add(at, y[rows].astype(np.int32), w[rows].astype(np.uint8), X[rows])
        yield packs.taken()

    def row(node, feature, cut, left, gain, weights):
        """A row of the table; leaves are numbered."""
        leaf = feature == LEAF
        left = np.where(leaf, np.cumsum(leaf) - 1, left)
        total = weights[leaf].sum(axis=1, keepdims=True)
        value = np.where(total > 0, weights[leaf] / np.where(total > 0, total, 1), 1.0 / k)
        return {"node": node, "n": len(feature), "feature": feature.astype(np.int16).tobytes(), "cut": cut.astype(np.uint8).tobytes(), "left": left.astype(np.int32).tobytes(),
                "value": value.tobytes(), "gains": np.bincount(feature[~leaf], weights=gain[~leaf], minlength=d).astype(float).tolist()}

    def subtree(pdf):
        n = int(pdf["node"].iloc[0])
        y, w, X = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("y", np.int32), ("w", np.uint8), ("bins", np.uint8)))
        tree, path, depth = small[n]  # weights are whole numbers, so sums do not depend on the order of arrival
        return pd.DataFrame([row(n, *local_tree(X.reshape(-1, d), y.astype(np.int64), w.astype(float), k, BINS, share, seed, tree, path, depth, entropy))])

    ends = [i for i in np.flatnonzero(forest.feature == LEAF) if not is_open[i]]
    one = np.zeros(1, np.int64)
    above = [row(int(i), one + LEAF, one, one, one.astype(float), np.asarray(grown.value[i], float)[None]) for i in ends]
    out = data.rows.sparkSession.createDataFrame([tuple(r.values()) for r in above], schema)
    if small:
        out = out.unionByName(data.rows.mapInPandas(deal, "node long, y binary, w binary, bins binary").groupBy("node").applyInPandas(subtree, schema))
    return staged(out, "subtrees")


# ---------------------------------------------------------------- AdaBoost

@dataclass
class Stumps:
    """Depth-1 members of some bags: arrays (bag, feature, bin, class at most / over it, weight of vote)."""

    bag: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    alpha: np.ndarray

    def log_weights(self, X: np.ndarray, y: np.ndarray, bag: int) -> np.ndarray:
        """Sum of the votes of the members that miss a row."""
        mine = np.flatnonzero(self.bag == bag)
        out = np.zeros(len(X))
        for i in mine:
            said = np.where(X[:, self.feature[i]] <= self.cut[i], self.low[i], self.high[i])
            out += self.alpha[i] * (said != y)
        return out


def boost_stumps(data: Binned, n_bags: int, rounds: int, bags: Bags | None = None, redraw: Bags | None = None) -> Stumps:
    """SAMME on stumps, all bags in lockstep.  ``bags``: which rows a bag holds; ``redraw``: rows that a
    round is fitted on (drawn anew each round), its error being measured on all rows of the bag."""
    d, k, bins = data.d, data.k, BINS
    done = Stumps(*(np.zeros(0, np.int64) for _ in range(5)), np.zeros(0))
    live = list(range(n_bags))
    blocks = [(lo, min(d, lo + BLOCK)) for lo in range(0, d, BLOCK)]

    for turn in range(rounds):
        def histograms(batches, done=done, live=tuple(live), turn=turn):
            held: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                X, y, h = _batch(pdf, d)
                for bag in live:
                    inside = bags.draw(h, y, bag) if bags else np.ones(len(y))
                    w = inside * np.exp(done.log_weights(X, y, bag))
                    fit = w * redraw.draw(h, y, bag * rounds + turn) if redraw else w
                    for i, (lo, hi) in enumerate(blocks):
                        found = np.stack([class_histogram(X[:, lo:hi], y, v, k, bins) for v in ((fit, w) if redraw else (w,))])
                        held[bag, i] = held[bag, i] + found if (bag, i) in held else found
            for (bag, i), hist in held.items():
                yield pd.DataFrame({"bag": [bag], "block": [i], "hist": [hist.ravel()]})

        def search(pdf):
            bag, i = int(pdf["bag"].iloc[0]), int(pdf["block"].iloc[0])
            lo, hi = blocks[i]
            hist = sum(pdf["hist"]).reshape(-1, hi - lo, bins, k)
            j, b, gain, left, right = best_class_split(hist[0])
            row = hist[-1][max(j, 0)]  # weights of all rows of the bag
            low, high = int(np.argmax(left)), int(np.argmax(right))
            total = row.sum()
            hit = row[:b + 1, low].sum() + row[b + 1:, high].sum() if j >= 0 else row[:, low].sum()
            return pd.DataFrame({"bag": [bag], "feature": [lo + j if j >= 0 else -1], "cut": [b], "low": [low], "high": [high if j >= 0 else low], "gain": [gain], "miss": [total - hit], "total": [total]})

        found = data.rows.mapInPandas(histograms, "bag int, block int, hist array<double>").groupBy("bag", "block").applyInPandas(
            search, "bag int, feature int, cut int, low int, high int, gain double, miss double, total double").toPandas()  # a row a bag and block
        new = []
        for bag, rows in found.groupby("bag", sort=True):
            best = rows.sort_values(["gain", "feature"], ascending=[False, True], kind="stable").iloc[0]
            err = best.miss / best.total if best.total > 0 else 1.0
            if best.feature < 0 or err >= 1 - 1 / k:
                live.remove(bag)
                continue
            alpha = math.log(max(1 - err, 1e-12) / max(err, 1e-12)) + math.log(k - 1)
            new.append((bag, int(best.feature), int(best.cut), int(best.low), int(best.high), alpha))
            if err <= 1e-12:
                live.remove(bag)
        live = [b for b in live if b in set(found["bag"])]
        if new:
            cols = list(zip(*new))
            done = Stumps(*(np.concatenate([getattr(done, f), np.array(c)]) for f, c in zip(("bag", "feature", "cut", "low", "high", "alpha"), cols)))
        if not live:
            break
    return done


def stump_forest(data: Binned, stumps: Stumps) -> FlatForest:
    """Shares of the votes in each bag, averaged over the bags that have members."""
    grown = Growing(data.k, data.edges)
    some = np.unique(stumps.bag)
    for i in range(len(stumps.bag)):
        scale = stumps.alpha[i] / stumps.alpha[stumps.bag == stumps.bag[i]].sum() / len(some)
        root = grown.node(np.zeros(data.k))
        grown.roots.append(root)
        grown.split(root, stumps.feature[i], stumps.cut[i], stumps.alpha[i], np.eye(data.k)[stumps.low[i]] * scale, np.eye(data.k)[stumps.high[i]] * scale)
    return grown.flat()


# ---------------------------------------------------------------- histogram boosting

def _softmax(S: np.ndarray) -> np.ndarray:
    e = np.exp(S - S.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient_histogram(X: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    """(feature, bin) sums of gradient, Hessian and rows."""
    m = X.shape[1]
    code = (np.arange(m) * bins + X).ravel()
    return np.stack([np.bincount(code, weights=np.repeat(v, m), minlength=m * bins).reshape(m, bins) for v in (g, h, np.ones(len(g)))])


def add_gradients(held: np.ndarray, X: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Add rows to ``held``, the histograms of some nodes; row i lies in node ``slot[i]`` of them."""
    n, _, m, bins = held.shape
    step = max(1, CELLS // m)
    for lo in range(0, len(X), step):
        some = slice(lo, lo + step)
        code = (X[some] + np.arange(m) * bins + (slot[some] * (m * bins))[:, None]).ravel()
        for i, v in enumerate((g, h, None)):
            held[:, i] += np.bincount(code, weights=None if v is None else np.repeat(v[some], m), minlength=n * m * bins).reshape(n, m, bins)


def best_gradient_split(hist: np.ndarray, least: int) -> tuple[int, int, float]:
    """(feature, bin, gain) of the largest second-order gain with ``least`` rows on each side; feature -1 if
    there is none."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist[:, :1].sum(axis=2, keepdims=True)
    right = total - left
    score = lambda p: p[0] ** 2 / (p[1] + 1e-12)
    gain = np.where((left[2] >= least - 0.5) & (right[2] >= least - 0.5), score(left) + score(right) - score(total), -np.inf)
    if not gain.size or not gain.max() > 1e-9:
        return -1, 0, 0.0
    j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return int(j), int(b), float(gain[j, b])


def local_levels(X: np.ndarray, g: np.ndarray, h: np.ndarray, rate: float, leaves: int, least: int, bins: int) -> list[tuple]:
    """Nodes (feature, bin, left, right, gain, step) of a boosted tree, the root first; grown level by level,
    the largest gains of a level first, as the distributed loop does."""
    nodes, level, n_leaves = [None], [(0, np.arange(len(g)))], 1
    while level:
        found = [(best_gradient_split(gradient_histogram(X[rows], g[rows], h[rows], bins), least), at, rows) for at, rows in level]
        level = []
        for (j, b, gain), at, rows in sorted(found, key=lambda x: (-x[0][2], x[1])):
            step = -rate * g[rows].sum() / (h[rows].sum() + 1e-12)
            if j < 0 or n_leaves >= leaves:
                nodes[at] = (LEAF, 0, 0, 0, 0.0, step)
                continue
            n_leaves += 1
            low = X[rows, j] <= b
            nodes += [None, None]
            nodes[at] = (j, b, len(nodes) - 2, len(nodes) - 1, gain, step)
            level += [(len(nodes) - 2, rows[low]), (len(nodes) - 1, rows[~low])]
    return nodes


def boost_histograms(data: Binned, rounds: int = HIST_ROUNDS, rate: float = LEARNING_RATE, leaves: int = LEAVES, least: int = LEAST_ROWS,
                     bins: int = HIST_BINS) -> tuple[FlatForest, np.ndarray, list[float]]:
    """(trees, class scores at the start, training log-loss before each round and after the last).  The
    driver holds the histograms of a level: classes x nodes x features x bins, none of which grows with
    the rows."""
    d, k = data.d, data.k
    start = np.log(np.maximum(data.counts, 1e-12) / data.counts.sum())
    rows = data.rows.withColumn("raw", F.array(*[F.lit(float(s)) for s in start]))
    parts, recent, losses = [], Growing(k, data.edges), []  # recent: the trees that are not in ``raw`` yet
    kept, small_table = [], data.counts.sum() <= SMALL

    def step(c: int, sums: np.ndarray) -> np.ndarray:
        """What a node of class c with these sums adds to the scores."""
        return np.eye(k)[c] * (-rate * sums[0] / (sums[1] + 1e-12))

    def gradients(pdf: pd.DataFrame, forest: FlatForest, trees: list[int]) -> tuple:
        """Bins, classes, probabilities and the loss of a batch.  All trees but the round's own (``trees``, one a
        class) correct the raw scores."""
        X, y, _ = _batch(pdf, d)
        raw = np.stack(pdf["raw"].to_numpy())
        for node in forest.ends(X, np.arange(trees[0]), True).T if trees[0] else ():
            raw = raw + forest.value[node]
        P = _softmax(raw)
        return X, y, P, -np.log(np.maximum(P[np.arange(len(y)), y], 1e-300)).sum()

    def grown_in_groups(forest: FlatForest, trees: list[int]) -> tuple[dict, float]:
        """Small tables: the whole tree of each class, one group each, and the loss."""
        def deal(batches):
            loss = 0.0
            for pdf in batches:
                if len(pdf):
                    _, y, P, more = gradients(pdf, forest, trees)
                    loss += more
                    for c in range(k):
                        yield pd.DataFrame({"c": c, "h": pdf["h"], "g": P[:, c] - (y == c), "s": P[:, c] * (1 - P[:, c]), "bins": pdf["bins"]})
            yield pd.DataFrame({"c": [-1], "h": [0], "g": [loss], "s": [0.0], "bins": [b""]})

        def tree(pdf):
            c = int(pdf["c"].iloc[0])
            if c < 0:
                return pd.DataFrame({"c": [c], "at": [0], "feature": [0], "cut": [0], "a": [0], "b": [0], "gain": [0.0], "step": [pdf["g"].sum()]})
            pdf = pdf.sort_values(["h", "g", "bins"], kind="stable")  # sums do not depend on the order of arrival
            X = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), d)
            nodes = local_levels(X, pdf["g"].to_numpy(), pdf["s"].to_numpy(), rate, leaves, least, bins)
            cols = list(zip(*nodes))
            return pd.DataFrame({"c": c, "at": range(len(nodes))} | dict(zip(("feature", "cut", "a", "b", "gain", "step"), cols)))

        found = rows.mapInPandas(deal, "c int, h long, g double, s double, bins binary").groupBy("c").applyInPandas(
            tree, "c int, at int, feature int, cut int, a int, b int, gain double, step double").toArrow().to_pylist()
        out: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r["c"], r["at"])):
            out.setdefault(r["c"], []).append(r)
        return out, out.pop(-1)[0]["step"]

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Bins, classes and raw scores of a batch."""
        return (np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(len(batch), d), batch["y"].to_numpy(),
                batch["raw"].flatten().to_numpy().reshape(len(batch), k))

    def summed(forest: FlatForest, wanted: list[tuple[int, int]], trees: list[int]) -> tuple[dict, float]:
        """Histograms of the nodes (class, node), and the loss."""
        asked = sorted({c for c, _ in wanted})
        own = {c: [i for i, (other, _) in enumerate(wanted) if other == c] for c in asked}

        def part(batches):
            held, loss = {c: np.zeros((len(own[c]), 3, d, bins)) for c in asked}, 0.0
            for batch in batches:
                if not len(batch):
                    continue
                X, y, raw = arrays(batch)
                P = _softmax(raw)
                loss -= np.log(np.maximum(P[np.arange(len(y)), y], 1e-300)).sum()
                ends = forest.ends(X, np.array(trees)[asked], True)
                for c, at in zip(asked, ends.T):
                    slot = np.full(len(forest.feature), -1)
                    slot[[wanted[i][1] for i in own[c]]] = np.arange(len(own[c]))
                    mine = np.flatnonzero(slot[at] >= 0)
                    p = P[mine, c]
                    add_gradients(held[c], X[mine], slot[at[mine]], p - (y[mine] == c), p * (1 - p))
            found = {i: hist.tobytes() for c in asked for i, hist in zip(own[c], held[c]) if hist[2].any()}
            yield pa.RecordBatch.from_arrays([pa.array([*found, -1], pa.int32()), pa.array([*found.values(), np.array(loss).tobytes()], pa.binary())], ["slot", "hist"])

        def added(pdf):
            return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "hist": [sum(np.frombuffer(b) for b in pdf["hist"]).tobytes()]})

        found = rows.mapInArrow(part, "slot int, hist binary").groupBy("slot").applyInPandas(added, "slot int, hist binary").toArrow().to_pylist()
        found = {r["slot"]: np.frombuffer(r["hist"]) for r in found}
        none = np.zeros((3, d, bins))
        return {key: found[i].reshape(3, d, bins) if i in found else none for i, key in enumerate(wanted)}, float(found[-1][0])

    def rescore(turn: int) -> None:
        """The trees so far go into the raw scores: as a written table from time to time, and, of tables that are
        not small, as a kept one after every other round."""
        nonlocal rows, recent, kept
        write = (turn + 1) % REWRITE == 0 or turn + 1 == rounds
        if not write and small_table:
            return
        forest = recent.flat()

        def rescored(batches):
            for batch in batches:
                if len(batch):
                    X, _, raw = arrays(batch)
                    raw = raw + forest.scores(X, True)
                    flat = pa.ListArray.from_arrays(np.arange(0, raw.size + 1, k, dtype=np.int32), raw.ravel())
                    yield pa.RecordBatch.from_arrays([flat if f == "raw" else batch[f] for f in batch.schema.names], batch.schema.names)

        rows = rows.mapInArrow(rescored, rows.schema)
        rows = staged(rows, "scores") if write else rows.persist(StorageLevel.MEMORY_AND_DISK)
        if write:
            for df in kept:
                df.unpersist()
        kept = [] if write else [*kept, rows]
        parts.append(forest)
        recent = Growing(k, data.edges)

    for turn in range(rounds):
        trees = []
        for c in range(k):
            recent.roots.append(recent.node(np.zeros(k)))
            trees.append(len(recent.roots) - 1)
        if small_table:
            found, loss = grown_in_groups(recent.flat(), trees)
            losses.append(loss / data.counts.sum())
            for c, nodes in found.items():
                place = {0: recent.roots[trees[c]]}
                for r in nodes:
                    at = place[r["at"]]
                    recent.value[at] = np.eye(k)[c] * r["step"]
                    if r["feature"] != LEAF:
                        place[r["a"]], place[r["b"]] = recent.split(at, r["feature"], r["cut"], r["gain"], np.zeros(k), np.zeros(k))
            rescore(turn)
            continue
        n_leaves = [1] * k
        hists: dict[tuple[int, int], np.ndarray] = {}
        wanted = [(c, recent.roots[t]) for c, t in enumerate(trees)]
        pairs: list[tuple[int, int, int, int]] = []  # (class, parent, counted child, other child)
        level = 0
        while wanted:
            now, loss = summed(recent.flat(), wanted, trees)
            if level == 0:
                losses.append(loss / data.counts.sum())
                for c, node in wanted:
                    recent.value[node] = step(c, now[c, node][:, 0].sum(axis=1))
            for c, parent, counted, other in pairs:
                now[c, other] = hists[c, parent] - now[c, counted]
            hists, pairs, level = now, [], level + 1
            ranked = sorted(((best_gradient_split(hist, least), key) for key, hist in now.items()), key=lambda x: (-x[0][2], x[1]))
            for (j, b, gain), (c, node) in ranked:
                if j < 0 or n_leaves[c] >= leaves:
                    continue
                n_leaves[c] += 1
                low, high = now[c, node][:, j, :b + 1].sum(axis=1), now[c, node][:, j, b + 1:].sum(axis=1)
                a, z = recent.split(node, j, b, gain, step(c, low), step(c, high))
                if max(low[2], high[2]) > 2 * least - 0.5:  # one of them could be split again
                    pairs.append((c, node, a, z) if low[2] <= high[2] else (c, node, z, a))
            pairs = [p for p in pairs if n_leaves[p[0]] < leaves]
            wanted = [(c, counted) for c, _, counted, _ in pairs]
        rescore(turn)
    loss = F.expr("aggregate(transform(raw, r -> exp(r - array_max(raw))), 0D, (s, x) -> s + x)")
    losses.append(rows.agg(F.avg(F.log(loss) - (F.col("raw")[F.col("y")] - F.array_max("raw")))).first()[0])
    return joined(parts), start, losses


def joined(parts: list[FlatForest]) -> FlatForest:
    """One table of the trees of all parts."""
    sizes = np.cumsum([0] + [len(p.feature) for p in parts[:-1]])
    moved = {f: np.concatenate([getattr(p, f) + n for p, n in zip(parts, sizes)]) for f in ("left", "right", "roots")}
    kept = {f: np.concatenate([getattr(p, f) for p in parts]) for f in ("feature", "cut", "threshold", "value")}
    return FlatForest(**moved, **kept, gains=sum(p.gains for p in parts))
