"""Resamplers against brute force on small frames with repeated rows and hot classes."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loupe.operators import resample as R


def frame(spark, X, y):
    rows = [(f"r{i}", X[i].tolist(), float(y[i])) for i in range(len(X))]
    return spark.createDataFrame(rows, "id string, x array<double>, label_idx double").select("id", array_to_vector("x").alias("features"), "label_idx")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(size=(70, 2)), rng.normal(size=(40, 2)) + 1.2, rng.normal(size=(20, 2)) * 0.5 - 1])
    y = np.repeat([0, 1, 2], [70, 40, 20])
    X[110:116] = X[110]  # repeated rows of the smallest class
    return X, y, frame(spark, X, y).cache()


def points(df):
    return [(r["_key"], r["label_idx"], np.array(r["x"])) for r in df.select("_key", "label_idx", vector_to_array("features").alias("x")).collect()]


def neighbours(X, k):
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    names = np.array([f"r{i}" for i in range(len(X))])
    return [sorted(range(len(X)), key=lambda j: (d[i, j], names[j]))[:k] for i in range(len(X))]


def test_smote_counts_are_exact_and_rows_lie_between_neighbours(data):
    X, y, df = data
    out = points(R.oversample("SME", df, key="id"))
    labels = [c for _, c, _ in out]
    assert [labels.count(float(c)) for c in (0, 1, 2)] == [70, 70, 70]
    assert len({k for k, _, _ in out}) == len(out)
    for key, c, x in out:
        if "#" in key:
            parent = int(key.split("#")[0][1:])
            mine = np.flatnonzero(y == c)
            local = neighbours(X[mine], 5)[list(mine).index(parent)]
            ends = X[mine][local]
            line = [np.linalg.norm(np.cross(e - X[parent], x - X[parent])) if not np.allclose(e, X[parent]) else np.linalg.norm(x - X[parent]) for e in ends]
            assert min(line) < 1e-9


def test_adasyn_follows_the_share_of_other_classes(data):
    X, y, df = data
    near = neighbours(X, 5)
    out = points(R.oversample("ADA", df, key="id"))
    for c in (1, 2):
        mine = np.flatnonzero(y == c)
        hard = np.array([np.mean([y[j] != c for j in near[i]]) for i in mine])
        want = np.rint(hard / hard.sum() * (70 - len(mine))).astype(int)
        made = {f"r{i}": 0 for i in mine}
        for key, label, _ in out:
            if "#" in key and label == c:
                made[key.split("#")[0]] += 1
        assert [made[f"r{i}"] for i in mine] == want.tolist()


def test_smote_nc_and_n_keep_codes(spark):
    rng = np.random.default_rng(3)
    y = np.repeat([0, 1], [40, 15])
    X = np.column_stack([rng.integers(0, 3, 55), rng.normal(size=55), rng.integers(0, 2, 55), rng.normal(size=55)]).astype(float)
    out = points(R.oversample("SNC", frame(spark, X, y), key="id", categorical=[0, 2]))
    assert sum(c == 1.0 for _, c, _ in out) == 40
    assert all(x[0] in (0, 1, 2) and x[2] in (0, 1) for _, _, x in out)
    new = [x for k, _, x in out if "#" in k]
    assert any(not np.isclose(X[:, 1], x[1]).any() for x in new)
    with pytest.raises(ValueError):
        R.oversample("SNC", frame(spark, X, y), key="id")
    codes = X.astype(int).astype(float) % 3
    out = points(R.oversample("SNN", frame(spark, codes, y), key="id"))
    assert sum(c == 1.0 for _, c, _ in out) == 40
    mine = codes[y == 1]
    assert all(all(v in mine[:, i] for i, v in enumerate(x)) for k, _, x in out if "#" in k)


def test_kmeans_and_other_smotes_fill_classes(data):
    _, _, df = data
    for code in ("KMS", "BRD", "SVM"):
        labels = [c for _, c, _ in points(R.oversample(code, df, key="id"))]
        assert labels.count(0.0) == 70 and labels.count(1.0) in (40, 70) and labels.count(2.0) in (20, 70)
    assert [c for _, c, _ in points(R.oversample("KMS", df, key="id"))].count(2.0) == 70


def test_neighbourhood_cleaning_and_one_sided_selection(data):
    X, y, df = data
    near = neighbours(X, 3)
    vote = [sum(y[j] == y[i] for j in near[i]) * 2 > 3 for i in range(len(X))]
    gone = {i for i in range(len(X)) if y[i] != 2 and not vote[i]}
    gone |= {j for i in range(len(X)) if y[i] == 2 and not vote[i] for j in near[i] if y[j] != 2}
    got = {k for k, _, _ in points(R.undersample("NCR", df, key="id"))}
    assert got == {f"r{i}" for i in range(len(X)) if i not in gone}

    kept = points(R.one_sided_selection(df, key="id"))
    assert sum(c == 2.0 for _, c, _ in kept) == 20
    sizes = [sum(c == v for _, c, _ in kept) for v in (0.0, 1.0)]
    assert sizes[0] < 70 and sizes[1] < 40


def test_hardness_and_near_miss_keep_the_smallest_size(data):
    _, _, df = data
    for code in ("IHT", "NMS", "RND"):
        labels = [c for _, c, _ in points(R.undersample(code, df, key="id"))]
        assert [labels.count(float(c)) for c in (0, 1, 2)] == [20, 20, 20]


def test_over_then_undersampling_keeps_synthetic_rows(data):
    _, _, df = data
    over = R.oversample("SME", df, key="id")
    for code in ("ENN", "NMS", "RND"):
        out = points(R.undersample(code, over))
        assert any("#" in k for k, _, _ in out) and len({k for k, _, _ in out}) == len(out)
    with pytest.raises(ValueError):
        R.undersample("ENN", df)


def test_kmeans_smote_searches_neighbours_once(data, monkeypatch):
    """One search a class and cluster; the rows are those of a second search."""
    from loupe.operators import knn
    X, y, df = data
    calls, search, make = [], knn.knn_join, R._make
    monkeypatch.setattr(knn, "knn_join", lambda left, *a, **b: (calls.append(left), search(left, *a, **b))[1])
    once = sorted((k, c, x.round(9).tolist()) for k, c, x in points(R.oversample("KMS", df, key="id")))
    n_once = len(calls)
    monkeypatch.setattr(R, "_make", lambda *a, nn=None, **b: make(*a, **b))
    assert sorted((k, c, x.round(9).tolist()) for k, c, x in points(R.oversample("KMS", df, key="id"))) == once
    assert n_once and len(calls) - n_once == 2 * n_once


def test_cluster_centroids_with_centres_as_a_table(spark, monkeypatch):
    """Every row is nearest to its cluster's mean, equal rows count by their number, the cost is near KMeans', and
    Spark ML's KMeans, which holds the centres on the driver, is not called."""
    from pyspark.ml.clustering import KMeans

    from loupe.operators import clusters
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(90, 3)), rng.normal(size=(60, 3))])
    X[:20] = X[0]  # 131 different rows of class 0
    y = np.repeat([0, 1, 2], [150, 90, 60])
    df = frame(spark, X, y).cache()

    def cost(rows):
        found = {c: np.array([x for _, label, x in rows if label == c]) for c in (0.0, 1.0)}
        return sum((((X[y == c][:, None] - found[c][None]) ** 2).sum(-1)).min(axis=1).sum() for c in found)
    plain = cost(points(R.undersample("CCS", df, key="id")))
    monkeypatch.setattr(R, "CENTRES_MOST", 10)
    monkeypatch.setattr(clusters, "BLOCK", 16)
    monkeypatch.setattr(clusters, "PART", 25)
    monkeypatch.setattr(KMeans, "fit", lambda *a: pytest.fail("KMeans on the driver"))
    got = points(R.undersample("CCS", df, key="id"))
    assert [sum(c == v for _, c, _ in got) for v in (0.0, 1.0, 2.0)] == [60, 60, 60] and len({k for k, _, _ in got}) == 180
    assert cost(got) < 1.1 * plain
    for c in (0, 1):
        C, mine = np.array([x for _, label, x in got if label == c]), X[y == c]
        at = ((mine[:, None] - C[None]) ** 2).sum(-1).argmin(axis=1)
        assert np.allclose([mine[at == i].mean(axis=0) for i in range(60)], C, atol=1e-3)
    same = points(R.undersample("CCS", frame(spark, np.repeat(X[:1], 80, axis=0), np.repeat([0, 1], [60, 20])), key="id"))
    assert [sum(c == v for _, c, _ in same) for v in (0.0, 1.0)] == [1, 20]
