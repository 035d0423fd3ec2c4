"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters (their first characters, then their
hash), sorted within the partitions, and each row is compared in full with its neighbours: equal
texts stand next to each other, and the one with the smallest id stays.

Texts that many rows share are found beforehand from a map-side combined count of hashes; their
rows get a slice number in the range key, so one text is spread over many partitions, and the few
slices are merged afterwards (a broadcast of at most 1/HOT_SHARE rows).  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.common import SPACE, hot_limit, staged

#: Characters of a text in the range key: splitters stay short, whatever the texts' length.
HEAD_CHARS = 64


def normalised(text: str) -> Column:
    """Text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id (smallest id of the equal texts), group_size, kept
    and text_sha256 (of the normalised text).

    Null and empty texts are equal.  Null ids come last: one is kept only if its group has no other
    id, and keep_id is then null.  Of repeated rows with the smallest id exactly one is kept.  An
    empty table gives an empty result; other columns of ``docs`` are not read."""
    n_rows = docs.count()
    limit = hot_limit(n_rows)
    # a row's place in the read table, so that slices also part rows without id or with one id
    texts = (docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"), F.monotonically_increasing_id().alias("position"))
             .select("id", "norm", "position", F.xxhash64("norm").alias("hash")))
    hot = (texts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
           .select("hash", F.ceil(F.col("n") / limit).alias("slices")))
    keyed = (texts.join(F.broadcast(hot), "hash", "left")
             .select("id", "norm", "hash", F.substring("norm", 1, HEAD_CHARS).alias("head"),
                     F.col("slices").isNotNull().alias("hot"),
                     F.coalesce(F.pmod(F.xxhash64("position"), F.col("slices")), F.lit(0).cast("long")).alias("slice")))
    neighbours = Window.partitionBy("head", "hash", "slice", "norm").orderBy(F.col("id").asc_nulls_last())
    whole = neighbours.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = staged(
        keyed.repartitionByRange("head", "hash", "slice")
        .select("id", "hot", "slice", "norm",
                F.first("id").over(whole).alias("run_keep"),
                F.count(F.lit(1)).over(whole).alias("run_size"),
                F.row_number().over(neighbours).alias("place"))
        .select("id", "hot", "slice", "run_keep", "run_size", "place", F.sha2("norm", 256).alias("text_sha256")),
        "content-sort")
    # of the slices that hold the smallest id (null last), the first keeps it
    first = F.min(F.struct(F.col("run_keep").isNull().alias("none"), "run_keep", "slice")).alias("first")
    merged = runs.where("hot").groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("all_size"))
    keep = F.when(F.col("hot"), F.col("first.run_keep")).otherwise(F.col("run_keep"))
    here = ~F.col("hot") | (F.col("slice") == F.col("first.slice"))
    return (runs.join(F.broadcast(merged), "text_sha256", "left")
            .select(F.col("id").alias(id_col), keep.alias("keep_id"),
                    F.coalesce("all_size", "run_size").alias("group_size"),
                    ((F.col("place") == 1) & F.col("id").eqNullSafe(keep) & here).alias("kept"), "text_sha256"))
