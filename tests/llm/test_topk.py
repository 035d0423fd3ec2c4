import math
import random

from pyspark.sql import functions as F

from loupe.llm import topk
from loupe.llm.queries import QUERIES
from loupe.llm.topk import exact_top_k


def brute(rows, k, every, scale=1024):
    good = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in {q for q, _ in good if q % every == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for name, a in good if name == q for i, b in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows(QUERIES["op5_exact_top_k"](spark, sf)) == brute(data, 10, 100)


def test_ties_hot_vectors_odd_rows_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(300)]
    data += [(1000 + i, data[40][1]) for i in range(200)] + [(1300 + i, [float(rng.randrange(-1, 2))] * 5) for i in range(60)]
    data += [(2000, None), (2010, [1.0, None, 2.0, 0.0, 0.0]), (2020, [float("nan")] * 5), (2030, [float("inf")] * 5), (2040, []), (2050, [3.0]), (None, [1.0] * 5),
             (2060, [9e9, -9e9, 1.0, 0.0, 0.0]), (10, data[10][1]), (-20, [0.5] * 5)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5).withColumns({"id": F.lit("x"), "vec": F.lit(1), "list": F.lit(2), "rank": F.lit(3)})
    for lists in (1, 2, 3):
        assert rows(exact_top_k(df, k=7, every=10, lists=lists)) == brute(data, 7, 10)


def test_fewer_rows_than_k_and_empty(spark):
    data = [(0, [1.0, -2.0]), (1, [-1.0, 0.5]), (2, [0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    assert rows(exact_top_k(df, k=10, every=1)) == brute(data, 10, 1)
    assert exact_top_k(df.limit(0)).collect() == []
    assert exact_top_k(df.where("vec_id = 0")).collect() == []


def test_an_id_with_several_vectors_is_several_candidates_and_queries(spark):
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    data += [(7, [5.0] * 4), (7, [6.0] * 4), (7, [5.0] * 4), (20, [-3.0, 1.0, 0.0, 2.0]), (20, [1.0] * 4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = rows(exact_top_k(df, k=5, every=20))
    assert got == brute(data, 5, 20) and [r[2] for r in got if r[0] == 0][:2].count(7) in (0, 2)


def test_the_norm_bound_keeps_phase_three_small(spark, monkeypatch):
    """Vectors whose strength lies in one list: without the bound nearly all of them would be sent."""
    rng = random.Random(3)
    data = [(i, [rng.gauss(0, 3) for _ in range(8)] + [rng.gauss(0, 0.01) for _ in range(8)]) for i in range(400)]
    sent = []
    real = topk.staged
    monkeypatch.setattr(topk, "staged", lambda df, what: (sent.append(out.count()) if what == "sent" else None, out)[1] if (out := real(df, what)) is not None else None)
    assert rows(exact_top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=5, every=100)) == brute(data, 5, 100)
    assert sent[0] < 4 * 400 / 4
