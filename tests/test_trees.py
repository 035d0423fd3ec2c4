"""Tree ensembles against plain numpy versions, and the registered ensemble queries at full settings."""
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loupe.operators import classifiers as A
from loupe.operators import trees as T
from loupe.plans import registry


def points(seed=0, n=300, d=5, k=3, values=12):
    rng = np.random.default_rng(seed)
    X = rng.integers(0, values, size=(n, d)).astype(float)
    y = ((X[:, 0] > 6).astype(int) + (X[:, 1] + X[:, 2] > 12)).clip(0, k - 1)
    y[rng.random(n) < 0.1] = rng.integers(0, k, size=n)[rng.random(n) < 0.1][0]
    return X, y


def frame(spark, X, y):
    rows = [(i, X[i].tolist(), float(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "_key long, x array<double>, label_idx double").select("_key", array_to_vector("x").alias("features"), "label_idx").repartition(3)


def gini_stump(X, y, w, k):
    """(feature, value, low class, high class) of the best stump, by trying all."""
    best = (-1.0, None)
    part = lambda m: np.bincount(y[m], weights=w[m], minlength=k)
    whole = part(np.ones(len(y), bool))
    for j in range(X.shape[1]):
        for v in np.unique(X[:, j])[:-1]:
            a, b = part(X[:, j] <= v), part(X[:, j] > v)
            gain = (a @ a) / a.sum() + (b @ b) / b.sum() - (whole @ whole) / whole.sum()
            if gain > best[0] + 1e-9:
                best = (gain, (j, v, int(a.argmax()), int(b.argmax())))
    return best[1]


def test_boosted_stumps_equal_a_plain_search(spark):
    X, y = points()
    data = T.bin_rows(frame(spark, X, y), 3, "_key")
    got = T.boost_stumps(data, 1, 12)
    w = np.ones(len(y))
    for i in range(12):
        j, v, low, high = gini_stump(X, y, w, 3)
        assert (got.feature[i], data.edges[j][got.cut[i]], got.low[i], got.high[i]) == (j, v, low, high)
        miss = np.where(X[:, j] <= v, low, high) != y
        err = w[miss].sum() / w.sum()
        alpha = math.log((1 - err) / err) + math.log(2)
        assert got.alpha[i] == pytest.approx(alpha)
        w = w * np.exp(alpha * miss)
    scores = T.stump_forest(data, got).scores(X)
    votes = np.zeros((len(y), 3))
    for i in range(12):
        said = np.where(X[:, got.feature[i]] <= data.edges[got.feature[i]][got.cut[i]], got.low[i], got.high[i])
        votes[np.arange(len(y)), said] += got.alpha[i] / got.alpha.sum()
    assert np.allclose(scores, votes)


def walk(forest, root, x):
    while forest.feature[root] != T.LEAF:
        root = forest.left[root] if x[forest.feature[root]] <= forest.threshold[root] else forest.right[root]
    return forest.value[root]


@pytest.mark.parametrize("share", [None, 2])
def test_forest_scores_equal_the_members_averaged(spark, share):
    X, y = points(1)
    data = T.bin_rows(frame(spark, X, y), 3, "_key")
    forest = T.grow_forest(data, 5, T.Bags(T.even_rates(data.counts, True), False, 3), share)
    members = [[walk(forest, r, x) * 5 for x in X] for r in forest.roots]
    assert np.allclose(np.array(members).sum(axis=2), 1)
    got = A.ForestFitted(spark, forest).transform(frame(spark, X, y)).orderBy("_key").collect()
    assert np.allclose([r.probability for r in got], np.mean(members, axis=0))
    assert [r.prediction for r in got] == list(np.argmax(np.mean(members, axis=0), axis=1))


def test_levels_by_histogram_grow_the_same_trees_as_groups(spark, monkeypatch):
    X, y = points(2, n=400)
    data = T.bin_rows(frame(spark, X, y), 3, "_key")
    bags = T.Bags((1.0, 1.0, 1.0), False, 0)
    whole = T.grow_forest(data, 3, bags, 2, depth=6)
    monkeypatch.setattr(T, "SMALL", 40)
    monkeypatch.setattr(T, "HELD", 5000)
    levels = T.grow_forest(data, 3, bags, 2, depth=6)
    assert len(levels.feature) == len(whole.feature) and np.allclose(levels.scores(X), whole.scores(X))


def test_a_full_tree_learns_its_rows_and_bags_are_balanced(spark):
    X, y = points(3)
    X = X + np.arange(len(y))[:, None] * 1e-3
    data = T.bin_rows(frame(spark, X, y), 3, "_key")
    h = np.random.default_rng(1).integers(0, 2**63, 60000).astype(np.uint64)
    labels = np.repeat([0, 1, 2], [40000, 15000, 5000])
    draws = T.Bags(T.even_rates(np.array([40000, 15000, 5000.0]), True), False, 1).draw(h, labels, 4)
    assert all(abs(draws[labels == c].sum() - 5000) < 400 for c in range(3)) and draws.max() >= 2
    once = T.Bags(T.even_rates(np.array([40000, 15000, 5000.0]), True), True, 1).draw(h, labels, 4)
    assert all(abs(once[labels == c].sum() - 5000) < 400 for c in range(3)) and once.max() == 1
    assert data.counts.sum() == len(y)


def plain_boosting(X, y, k, rounds, rate, leaves, least):
    """The same rule without bins or histograms (each distinct value is a threshold)."""
    n = len(y)
    start = np.log(np.bincount(y, minlength=k) / n)
    raw, losses = np.tile(start, (n, 1)), []
    for _ in range(rounds):
        P = T._softmax(raw)
        losses.append(-np.log(P[np.arange(n), y]).mean())
        for c in range(k):
            g, h = P[:, c] - (y == c), P[:, c] * (1 - P[:, c])
            level, n_leaves = [np.arange(n)], 1
            while level:
                found = []
                for rows in level:
                    raw_step = -rate * g[rows].sum() / (h[rows].sum() + 1e-12)
                    best = (1e-9, None)
                    for j in range(X.shape[1]):
                        for v in np.unique(X[rows, j])[:-1]:
                            a, b = rows[X[rows, j] <= v], rows[X[rows, j] > v]
                            if min(len(a), len(b)) >= least:
                                s = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1e-12)
                                gain = s(a) + s(b) - s(rows)
                                if gain > best[0] + 1e-12:
                                    best = (gain, (a, b))
                    found.append((best[0], rows, raw_step, best[1]))
                level = []
                for gain, rows, step, parts in sorted(found, key=lambda x: -x[0]):
                    if parts is None or n_leaves >= leaves:
                        raw[rows, c] += step
                    else:
                        n_leaves += 1
                        level += parts
    P = T._softmax(raw)
    return raw, losses + [-np.log(P[np.arange(n), y]).mean()]


@pytest.mark.parametrize("small", [T.SMALL, 10])
def test_histogram_boosting_equals_a_plain_version_and_lowers_the_loss(spark, monkeypatch, small):
    monkeypatch.setattr(T, "REWRITE", 3)
    monkeypatch.setattr(T, "SMALL", small)
    X, y = points(4, n=160, d=3)
    data = T.bin_rows(frame(spark, X, y), 3, "_key", bins=T.HIST_BINS)
    forest, start, losses = T.boost_histograms(data, rounds=7, leaves=5, least=8)
    raw, want = plain_boosting(X, y, 3, 7, T.LEARNING_RATE, 5, 8)
    assert np.allclose(losses, want) and all(b < a for a, b in zip(losses, losses[1:]))
    assert np.allclose(start + forest.scores(X), raw)


def test_boosting_passes_score_by_their_own_round_and_end_with_the_last_split(spark, monkeypatch):
    """Trees of earlier rounds are in the kept scores, and no pass is made for nodes that stay leaves."""
    monkeypatch.setattr(T, "SMALL", 10)
    X, y = points(8, n=120, d=3)
    data = T.bin_rows(frame(spark, X, y), 3, "_key", bins=T.HIST_BINS)
    trees, searched, flat, search = [], [], T.Growing.flat, T.best_gradient_split
    monkeypatch.setattr(T.Growing, "flat", lambda self, *a: (trees.append(len(self.roots)), flat(self, *a))[1])
    monkeypatch.setattr(T, "best_gradient_split", lambda *a: (searched.append(a), search(*a))[1])
    forest, start, losses = T.boost_histograms(data, rounds=4, leaves=2, least=8)
    raw, want = plain_boosting(X, y, 3, 4, T.LEARNING_RATE, 2, 8)
    assert np.allclose(losses, want) and np.allclose(start + forest.scores(X), raw)
    assert max(trees) == 3 and len(searched) == 4 * 3


@pytest.mark.parametrize("name", ["A6_hist_gradient_boosting", "A7_adaboost", "A8_bagging", "A24_balanced_random_forest", "A25_balanced_bagging", "A26_rusboost",
                                  "A27_easy_ensemble", "A30_stacked_forests"])
def test_registered_ensembles_run_at_the_library_settings(spark, sf, name):
    registry.load_all()
    rows = registry.QUERIES[name](spark, sf).collect()
    assert rows and all(r.predicted is not None and 0 <= r.rate <= 1 for r in rows)


def test_the_plan_does_not_grow_with_the_members(spark):
    X, y = points(5, n=120)
    train = frame(spark, X, y)
    plans = [A.fit_bagging(train, 3, n_bags=n).transform(train)._jdf.queryExecution().optimizedPlan().toString() for n in (2, 40)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())


def test_one_class_and_constant_features(spark):
    X = np.ones((30, 2))
    y = np.zeros(30, int)
    for code in ("ABC", "BGC", "BARF", "EAEC"):
        got = A.fit(code, frame(spark, X, y), 1 if code == "BGC" else 2).transform(frame(spark, X, y)).select("prediction").distinct().collect()
        assert [r.prediction for r in got] == [0.0]
    rng = np.random.default_rng(0)
    mixed = A.fit("HIST", frame(spark, X, rng.integers(0, 2, 30)), 2, rounds=2).transform(frame(spark, X, y)).count()
    assert mixed == 30 and F is not None


@pytest.mark.parametrize("entropy", [False, True])
def test_written_subtrees_score_as_one_table_and_the_driver_holds_the_top(spark, monkeypatch, entropy):
    X, y = points(6, n=400)
    X[:150] = X[0]  # a node that no feature parts
    data = T.bin_rows(frame(spark, X, y), 3, "_key")
    bags = T.Bags((1.0, 1.0, 1.0), False, 0)
    whole = T.grow_forest(data, 4, bags, 2, seed=1, entropy=entropy)
    for name, value in (("FINISH", 60), ("HELD", 5000), ("NODES_MOST", 0), ("SCORED", 150)):
        monkeypatch.setattr(T, name, value)
    dealt = T.grow_forest(data, 4, bags, 2, seed=1, entropy=entropy)
    assert isinstance(whole, T.FlatForest) and isinstance(dealt, T.DealtForest)
    assert len(dealt.top.feature) < len(whole.feature) / 2 and np.allclose(dealt.gains, whole.gains)
    assert dealt.parts.count() == (dealt.top.feature == T.LEAF).sum()
    want = whole.scores(X)
    got = A.DealtForestFitted(dealt).transform(frame(spark, X, y)).orderBy("_key").collect()
    assert np.allclose([r.probability for r in got], want, atol=1e-9)
    assert all(want[i, int(r.prediction)] == pytest.approx(want[i].max()) for i, r in enumerate(got))


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_random_forest_is_grown_by_levels_and_learns(spark, criterion):
    X, y = points(7)
    m = A.fit("RFCL", frame(spark, X, y), 3, trees=20, criterion=criterion)
    assert isinstance(m, A.ForestFitted)
    got = m.transform(frame(spark, X, y)).collect()
    assert len(got) == len(y) and sum(r.prediction == r.label_idx for r in got) > 0.9 * len(y)
    assert all(sum(r.probability) == pytest.approx(1) for r in got)


@pytest.mark.parametrize("share", [None, 2])
def test_nodes_of_few_rows_are_searched_without_class_histograms(monkeypatch, share):
    """Before, every node had a histogram of all bins and classes, most of them for a handful of rows."""
    rng = np.random.default_rng(3)
    X, y = rng.integers(0, 32, (900, 5)).astype(np.uint8), rng.integers(0, 4, 900)
    X[:200] = X[0]  # rows that no feature parts
    X[:, 4] = 31
    w = rng.poisson(1.0, 900).astype(float)
    X, y, w = X[w > 0], y[w > 0], w[w > 0]
    search, searched = T.best_class_splits, []
    monkeypatch.setattr(T, "best_class_splits", lambda hist, entropy=False: searched.append(len(hist)) or search(hist, entropy))
    grow = lambda: T.local_tree(X, y, w, 4, 32, share, 5, 1, 1, 30)
    got, few = grow(), sum(searched)
    monkeypatch.setattr(T, "BIN_BITS", 0)  # all by histograms
    want, many = grow(), sum(searched) - few
    assert all((a == b).all() for a, b in zip(got, want)) and len(want[0]) > 300
    assert 0 < few < many / 10
    halves = T.local_tree(X, y, w / 2, 4, 32, share, 5, 1, 1, 30)  # no whole numbers: by histograms
    assert (halves[0] == want[0]).all()


def test_one_class_in_a_few_rows_of_one_bin_is_no_split():
    for bins in (1, 32):
        j, cut, gain = T._splits_by_order(np.zeros((3, 2), np.uint8), np.array([0, 1, 1]), np.array([1.0, 2.0, 1.0]), np.array([0, 0, 0]), 1, 2, bins, False)
        assert j.tolist() == [-1] and cut.tolist() == [0] and gain.tolist() == [0.0]


def test_packs_hold_all_rows_of_a_group(monkeypatch):
    monkeypatch.setattr(T, "HELD", 400)
    packs, rng, made, want = T.Packs("key", "a", "b"), np.random.default_rng(0), [], []
    for n in (0, 7, 60, 1):
        key, a, b = rng.integers(0, 3, n), rng.integers(0, 99, n), rng.integers(0, 255, (n, 2)).astype(np.uint8)
        want += [(int(k), int(x), bytes(z)) for k, x, z in zip(key, a, b)]
        made += packs.add(key, a, b)
    made.append(packs.taken())
    got = [(r.key, int(x), bytes(z)) for t in made for r in t.itertuples() for x, z in zip(np.frombuffer(r.a, np.int64), np.frombuffer(r.b, np.uint8).reshape(-1, 2))]
    assert sorted(got) == sorted(want) and len(made) > 1 and not len(packs.taken())
