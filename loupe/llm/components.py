"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import attach, staged


def _digest(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _least_neighbour(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, least, degree): map-side combined, so a vertex of many edges costs a few rows."""
    return staged(pairs.groupBy(F.col(key).alias("key"))
                  .agg(F.min(value).alias("least"), F.count(F.lit(1)).alias("degree")), "least")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node that has an edge.

    ``edges`` has long columns u and v; loops, repeated and reversed edges do no harm, an empty
    table gives an empty result.  A round joins every vertex's edges to its least neighbour; hubs
    are spread by ``attach``.  Rounds go on until nothing changes (of the order of log n of them),
    and each round's edges are written to the shared folder."""
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    now = _digest(e)
    while now[0]:
        # large-star: the larger neighbours of a vertex move to its least neighbour
        ends = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(ends, "u", "v")
        large = attach(e.withColumn("key", F.col("v")), least, "key", "degree", now[0])
        e1 = staged(large.select("u", F.least("v", "least").alias("v")).distinct(), "edges")
        # small-star: the smaller neighbours of a vertex move to the least of them
        least = _least_neighbour(e1, "u", "v")
        small = attach(e1.withColumn("key", F.col("u")), least, "key", "degree", now[0])
        moved = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        e = staged(moved.unionByName(small.select("u", F.col("least").alias("v"))).distinct(), "edges")
        after = _digest(e)
        if after == now:
            break
        now = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
