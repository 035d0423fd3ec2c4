"""Quartiles by distributed selection and exact column uniqueness against plain Python."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.operators import profile as P
from loupe.sources import tables as S


@pytest.fixture(scope="module")
def values():
    r = random.Random(4)
    return {"even": [r.uniform(-5, 5) for _ in range(2000)],
            "tail": [10.0 ** r.uniform(-8, 8) * r.choice((1, -1)) for _ in range(2000)],
            "hot": [7.0 if r.random() < 0.4 else float(r.randrange(40)) for _ in range(2000)],
            "holes": [None if r.random() < 0.3 else r.gauss(730000, 1) for _ in range(2000)],
            "none": [None] * 2000, "wide": [r.choice((1.7e308, -1.7e308, 0.0)) for _ in range(2000)]}


@pytest.fixture(scope="module")
def df(spark, values):
    cols = list(values)
    return spark.createDataFrame(list(zip(*values.values())), ", ".join(f"{c} double" for c in cols)).repartition(6).cache()


@pytest.mark.parametrize("bins,most", [(32, 40), (1024, 100_000)])
def test_order_statistics_equal_sorting(df, values, bins, most):
    plain = {c: sorted(v for v in vs if v is not None) for c, vs in values.items()}
    ranks = {c: sorted({0, 1, len(v) // 4, len(v) // 2, len(v) // 2 + 1, len(v) - 1}) if v else [] for c, v in plain.items()}
    got = P.order_statistics(df, ranks, bins, most)
    assert got == {(c, r): plain[c][r] for c in ranks for r in ranks[c]}


def test_order_statistics_of_infinite_values_and_nan(spark):
    d = spark.createDataFrame([(v,) for v in (math.nan, math.inf, -math.inf, 3.0, 1.0, None, math.inf)], "x double")
    got = P.order_statistics(d, {"x": [0, 1, 2, 3, 4, 5]})
    assert [got["x", r] for r in range(5)] == [-math.inf, 1.0, 3.0, math.inf, math.inf] and math.isnan(got["x", 5])
    with pytest.raises(ValueError, match="rank outside"):
        P.order_statistics(d, {"x": [6]})


def test_describe_equals_numpy_and_empty_tables(df, values, spark):
    rows = {r["column_name"]: r for r in P.describe(df).collect()}
    for c in ("even", "hot", "holes"):
        v = np.array([x for x in values[c] if x is not None])
        assert rows[c]["count"] == len(v)
        assert np.allclose([rows[c][q] for q in ("min", "p25", "p50", "p75", "max")], np.percentile(v, [0, 25, 50, 75, 100]))
    assert rows["none"]["count"] == 0 and rows["none"]["p50"] is None
    empty = P.describe(df.filter("even > 100")).collect()
    assert len(empty) == 6 and all(r["count"] == 0 and r["p25"] is None for r in empty)
    assert P.describe(spark.createDataFrame([("a",)], "t string")).collect() == []


def test_uniqueness_of_every_type(spark):
    rows = [(1, 0.0, "a", b"x", [1], "l" * 100), (2, -0.0, None, b"y", [1], "l" * 100 + "m"), (3, math.nan, "a", None, [2, None], None),
            (4, math.nan, "=", b"x", None, "l" * 100)]
    d = spark.createDataFrame(rows, "`i.d` int, f double, s string, b binary, a array<int>, l string")
    got = {r["column_name"]: tuple(r)[1:] for r in S.column_uniqueness(d).collect()}
    assert got == {"i.d": (4, 4, 4), "f": (4, 4, 2), "s": (4, 3, 2), "b": (4, 3, 2), "a": (4, 3, 2), "l": (4, 3, 2)}
    assert [r[0] for r in S.unique_int_keys(d).collect()] == ["i.d"]
    none = {r["column_name"]: tuple(r)[1:] for r in S.column_uniqueness(d.filter("f = 9")).collect()}
    assert set(none.values()) == {(0, 0, 0)} and len(none) == 6


def test_one_duplicate_in_many_rows_is_found(spark):
    d = spark.range(20000).select(F.col("id"), F.when(F.col("id") == 19999, 5).otherwise(F.col("id")).alias("twice"),
                                  F.when(F.col("id") < 7000, 1).otherwise(F.col("id")).alias("hot"))
    assert [r[0] for r in S.unique_int_keys(d).collect()] == ["id"]
