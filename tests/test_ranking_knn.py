"""Ranking metrics against brute force at 200,000 rows, and the pivot kNN join against all pairs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.operators import metrics as M
from loupe.operators.knn import knn_join, radius_votes


@pytest.fixture(scope="module")
def scored(spark):
    n = 200_000
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1 << 20)) / float(1 << 20)
    df = spark.range(n).withColumn("label_idx", (u(1) < 0.4).cast("double"))
    s = F.round(F.least(F.greatest(u(2) * 0.8 + F.col("label_idx") * 0.2, F.lit(0.0)), F.lit(1.0)), 5)
    df = df.withColumn("s", s).withColumn("probability", F.array(1 - F.col("s"), F.col("s"))).repartition(16)
    pdf = df.select("label_idx", "s").toPandas()
    return df, pdf["label_idx"].to_numpy(), pdf["s"].to_numpy()


def test_auc_equals_brute_force_twice(scored):
    df, y, s = scored
    order = np.argsort(s, kind="stable")
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n1 = y.sum()
    want = (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
    assert len(order) == 200_000
    for _ in range(2):
        assert M.auc_ovo(df, 2).first()["auc"] == pytest.approx(want, abs=1e-9)


def test_average_precision_equals_brute_force_twice(scored):
    df, y, s = scored
    values, inverse = np.unique(-s, return_inverse=True)
    pos, n = np.bincount(inverse, y), np.bincount(inverse)
    tp, all_ = np.cumsum(pos), np.cumsum(n)
    want = (pos * tp / all_).sum() / y.sum()
    assert len(values) > 1000
    for _ in range(2):
        assert M.average_precision(df, 2).first()["average_precision_macro"] == pytest.approx(want, abs=1e-9)


def test_knn_join_on_clusters_is_exact_and_saves_pairs(spark, monkeypatch):
    from loupe.operators import knn
    monkeypatch.setattr(knn, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6)) * 50
    X = np.concatenate([c + rng.normal(size=(40, 6)) for c in centres] + [np.repeat(centres[:1], 240, axis=0)])
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(X)], "id long, x array<double>, y int")
    stats = {}
    got = {}
    for r in knn_join(df, df, 4, exclude_self=True, stats=stats, right_cols=("y",)).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["dist"], r["right_id"], r["y"]))
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(X)):
        rows = sorted(got[i])
        assert [x[2] for x in rows] == np.lexsort((np.arange(len(X)), d[i]))[:4].tolist()
        assert np.allclose([x[1] for x in rows], np.sort(d[i])[:4]) and all(y == j % 3 for _, _, j, y in rows)
    assert stats["pairs_compared"] < 0.6 * len(X) ** 2


def test_knn_join_sends_a_row_once_to_many_cells(spark):
    """Rows without structure need nearly all cells, but their vectors are copied by region."""
    rng = np.random.default_rng(5)
    X = rng.normal(size=(1500, 24))
    X[700:800] = X[0]  # ties that fill more than the k best
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>")
    stats, got = {}, {}
    for r in knn_join(df, df, 5, exclude_self=True, stats=stats).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"]))
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(X)):
        assert [j for _, j in sorted(got[i])] == np.lexsort((np.arange(len(X)), d[i]))[:5].tolist()
    assert stats["rows_sent"] <= 2 * len(X)  # 38 cells, one region: before, a copy for each cell


def test_regions_are_bounded_or_one_cell():
    from loupe.operators.knn import _regions
    rng = np.random.default_rng(6)
    count = rng.integers(0, 200, size=300)
    count[7] = 5000
    region = _regions(rng.normal(size=(300, 8)), count, 1000)
    held = np.bincount(region, weights=count)
    assert held.sum() == count.sum() and len(held) <= 4 * count.sum() / 1000
    assert all(n <= 1000 or (region == i).sum() == 1 for i, n in enumerate(held))


def test_radius_votes_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(120, 3))
    df = spark.createDataFrame([(i, x.tolist(), float(i % 2)) for i, x in enumerate(X)], "id long, x array<double>, y double")
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    want = {(i, float(c)): int(((d[i] <= 0.9) & (np.arange(120) % 2 == c)).sum()) for i in range(120) for c in (0, 1)}
    got = {(r["left_id"], r["y"]): r["n"] for r in radius_votes(df, df, 0.9, "y").collect()}
    assert got == {k: v for k, v in want.items() if v}
