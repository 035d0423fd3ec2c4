"""K-means with a number of centres that grows with the rows (U3), for all classes of a table at once.

Spark ML's KMeans holds its centres on the driver and picks them there among all candidates, in one process.
Here points and centres are tables:

* Equal rows of a class are one point with a weight.
* Seeding: in ``SEEDINGS`` rounds, points are drawn as centres by weight and squared distance to the nearest
  centre so far (the first round: by weight), exactly k in all.
* Lloyd's iterations with exact nearest centres.  A point at distance 0 from its centre is not searched for.  Of
  the others, one whose centre stood still or came nearer looks at the centres that moved; only one whose centre
  went away looks at all.

A search compares blocks of centres with parts of the points in numpy, so the memory of a group is bounded.  Its
pairs are at most points times centres; where k is near the number of points, as for classes of nearly equal
sizes, few points are searched for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.session import staged

LABEL, KEY = "label_idx", "_key"
#: Centres of a block, points of a part, and distances held at once.
BLOCK, PART, PAIRS = 1 << 14, 1 << 13, 1 << 21
#: Rounds of seeding; iterations and the least move of a centre (those of Spark ML).
SEEDINGS, ITERATIONS, TOL = 4, 20, 1e-4


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, found: (d2, c)): of every point (label, id, x, full) the nearest centre (label, c, x, moved) of its
    class; points that are not ``full`` look at moved centres only."""
    blocks = centres.groupBy(LABEL, "moved").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))  # two rows a class at most
    parts = points.groupBy(LABEL).agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    left = (points.join(F.broadcast(parts), LABEL).join(F.broadcast(blocks), LABEL).where(F.col("moved") | F.col("full"))
            .withColumn("part", F.pmod(F.xxhash64("id"), "parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(F.col(LABEL).alias("class"), F.col("moved").alias("kind"), "block", "part", "id", "x"))
    right = (centres.join(F.broadcast(blocks), [LABEL, "moved"]).join(F.broadcast(parts), LABEL)
             .withColumn("block", F.pmod(F.xxhash64("c"), "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(F.col(LABEL).alias("class"), F.col("moved").alias("kind"), "block", "part", "c", "x"))

    def search(points: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(centres):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "d2": np.zeros(0)})
        centres = centres.sort_values("c")  # the first of equally near ones counts
        X, C = np.stack(points["x"].to_numpy()), np.stack(centres["x"].to_numpy())
        half, at, step = (C * C).sum(axis=1) / 2, np.zeros(len(X), np.int64), max(1, PAIRS // len(C))
        for lo in range(0, len(X), step):
            at[lo:lo + step] = (half - X[lo:lo + step] @ C.T).argmin(axis=1)
        return pd.DataFrame({"id": points["id"].to_numpy(), "c": centres["c"].to_numpy()[at], "d2": ((X - C[at]) ** 2).sum(axis=1)})

    keys = ("class", "kind", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "id long, c long, d2 double")
    return found.groupBy("id").agg(F.min(F.struct("d2", "c")).alias("found"))


def _seeded(points: DataFrame, k: int, labels: list[float], seed: int) -> DataFrame:
    """The points (label, x, n, id) with c, d2: the nearest of k centres, which are points, and its squared distance."""
    from loupe.operators.resample import take_per_class
    state = points.withColumns({"c": F.lit(None).cast("long"), "d2": F.lit(None).cast("double")})
    for i in range(SEEDINGS):
        n_new = k * (i + 1) // SEEDINGS - k * i // SEEDINGS
        u = (F.shiftrightunsigned(F.xxhash64("x", F.lit(seed), F.lit(i)), 11) + 0.5) / 2.0**53
        free = state.where(F.col("c").isNull() | (F.col("c") != F.col("id"))).withColumn(KEY, F.col("id").cast("string"))
        weight = F.col("n") * F.greatest(F.coalesce("d2", F.lit(1.0)), F.lit(1e-300))
        drawn = take_per_class(free, {c: n_new for c in labels}, seed, order=-F.log(u) / weight).select(LABEL, F.col("id").alias("c"), "x")
        drawn = staged(drawn.withColumn("moved", F.lit(True)), "centres")
        rest = free.join(drawn.select(F.col("c").alias("id")), "id", "left_anti").select(LABEL, "id", "x", F.lit(False).alias("full"))
        found = nearest(rest, drawn)
        own = drawn.select(F.col("c").alias("id"), F.lit(True).alias("_own"))
        better = F.col("found").isNotNull() & (F.col("d2").isNull() | (F.col("found.d2") < F.col("d2")))
        state = staged(state.join(found, "id", "left").join(own, "id", "left").select(
            LABEL, "x", "n", "id", F.when(F.col("_own"), F.col("id")).when(better, F.col("found.c")).otherwise(F.col("c")).alias("c"),
            F.when(F.col("_own"), 0.0).when(better, F.col("found.d2")).otherwise(F.col("d2")).alias("d2")), "assigned")
    return state


def _means(state: DataFrame) -> DataFrame:
    vectors = state.withColumn("x", array_to_vector("x")).withColumn("n", F.col("n").cast("double"))
    return vectors.groupBy(LABEL, "c").agg(Summarizer.mean(F.col("x"), F.col("n")).alias("x"))


def cluster_means(rows: DataFrame, k: int, labels: list[float], seed: int = 0) -> DataFrame:
    """The means (label, c, x: vector) of k clusters of each class of ``rows`` (label, x: array); fewer where a
    class has fewer different rows or a cluster ends empty."""
    points = staged(rows.groupBy(LABEL, "x").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "points")
    state = _seeded(points, k, labels, seed)
    centres = state.where(F.col("c") == F.col("id")).select(LABEL, "c", "x")
    for _ in range(ITERATIONS):
        apart = state.where(F.col("d2") > 0).select("c").distinct()  # other clusters are single points in their places
        means = _means(state.join(apart, "c", "left_semi")).select("c", vector_to_array("x").alias("_to"))
        move = centres.join(means, "c").where(_squared(F.col("x"), F.col("_to")) > TOL * TOL)
        move = staged(move.select("c", "_to"), "moves")
        if move.isEmpty():
            break
        centres = staged(centres.join(move, "c", "left").select(LABEL, "c", F.coalesce("_to", "x").alias("x"), F.col("_to").isNotNull().alias("moved")), "centres")
        now = F.when(F.col("_to").isNull(), F.col("d2")).otherwise(_squared(F.col("x"), F.col("_to")))
        state = staged(state.join(move, "c", "left").withColumn("_now", now).select(
            LABEL, "x", "n", "id", "c", F.col("_now").alias("d2"), (F.col("_now") > F.col("d2")).alias("full")), "measured")
        found = nearest(state.where(F.col("d2") > 0).select(LABEL, "id", "x", "full"), centres)
        better = F.col("found").isNotNull() & (F.col("found.d2") < F.col("d2"))
        state = staged(state.join(found, "id", "left").select(
            LABEL, "x", "n", "id", F.when(better, F.col("found.c")).otherwise(F.col("c")).alias("c"),
            F.when(better, F.col("found.d2")).otherwise(F.col("d2")).alias("d2")), "assigned")
        centres = centres.drop("moved")
    return _means(state)
