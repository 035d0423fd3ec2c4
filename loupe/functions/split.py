"""Seeded, shuffle-free row randomness.

Order is not a table property in Spark, so every "random" choice is a pure function of
``(seed, key)``: the first 8 hex digits of ``md5(seed || '|' || key)`` read as an unsigned
32-bit number and scaled into [0, 1).  The same expression exists in DuckDB, which makes
splits, folds and samples checkable against SQL.  No window, no global sort, no shuffle:
the cost is one projection per row whatever the table size or class skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _key_text(seed, key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(str(seed)), F.lit("|"), k.cast("string"))


def hash_bits(seed, key, part: int = 0) -> Column:
    """32 bits of the md5 (``part`` 0..3 picks which 8 hex digits)."""
    return F.conv(F.substring(F.md5(_key_text(seed, key)), 1 + 8 * part, 8), 16, 10).cast("bigint")


def hash_unit(seed, key, part: int = 0) -> Column:
    """Uniform number in [0, 1) from (seed, key)."""
    return hash_bits(seed, key, part) / F.lit(TWO_POW_32)


def sql_hash_unit(seed, key_sql: str, part: int = 0) -> str:
    """The same value written in DuckDB SQL (for oracles)."""
    return (f"(('0x' || substr(md5('{seed}' || '|' || CAST({key_sql} AS VARCHAR)), {1 + 8 * part}, 8))"
            f"::BIGINT / {TWO_POW_32})")


def sql_hash_bits(seed, key_sql: str, part: int = 0) -> str:
    return f"(('0x' || substr(md5('{seed}' || '|' || CAST({key_sql} AS VARCHAR)), {1 + 8 * part}, 8))::BIGINT)"


def shuffle_key(seed, key) -> Column:
    """A random but reproducible sort key; unlabelled rows sort last via the caller."""
    return F.md5(_key_text(seed, key))


def split_column(seed, key, test_size: float) -> Column:
    """P17 (hash mode): 'test' with probability ``test_size``, stratified in expectation."""
    return F.when(hash_unit(seed, key, 0) < F.lit(float(test_size)), F.lit("test")).otherwise(F.lit("train"))


def fold_column(seed, key, k: int) -> Column:
    """P18 (hash mode): fold number 0..k-1, independent bits from the split."""
    return F.pmod(hash_bits(seed, key, 1), F.lit(int(k))).cast("int")


def stratified_split_exact(df: DataFrame, key: str, label: str, test_size: float, seed,
                           bins: int = 4096) -> DataFrame:
    """P17 (exact mode): exactly ``ceil(n_c * test_size)`` test rows per class.

    Scales without a window over a whole class: rows are histogrammed on (label, bin of the
    hash), the small per-class cumulative histogram finds the boundary bin, rows below it are
    test, and only the boundary bin of each class (about n_c / bins rows) is ranked exactly.
    """
    u = hash_unit(seed, key, 0)
    h = df.withColumn("_u", u).withColumn("_bin", F.floor(F.col("_u") * bins).cast("int"))
    hist = h.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    totals = hist.groupBy(label).agg(F.sum("_n").alias("_nc"))
    # cumulative counts inside the (classes x bins) table: at most 30 * bins rows
    from pyspark.sql import Window
    w = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = (hist.join(F.broadcast(totals), label)
           .withColumn("_cum", F.sum("_n").over(w))
           .withColumn("_target", F.ceil(F.col("_nc") * F.lit(float(test_size))).cast("bigint"))
           .withColumn("_before", F.col("_cum") - F.col("_n")))
    plan = cum.select(label, "_bin", "_before", "_target",
                      F.when(F.col("_cum") <= F.col("_target"), F.lit("all"))
                      .when(F.col("_before") >= F.col("_target"), F.lit("none"))
                      .otherwise(F.lit("part")).alias("_mode"))
    joined = h.join(F.broadcast(plan), [label, "_bin"], "left")
    wb = Window.partitionBy(label, "_bin").orderBy("_u", key)
    boundary_rank = F.row_number().over(wb)
    part = joined.filter(F.col("_mode") == "part").withColumn("_r", boundary_rank)
    part = part.withColumn("split", F.when(F.col("_before") + F.col("_r") <= F.col("_target"), "test")
                           .otherwise("train"))
    rest = joined.filter(F.col("_mode") != "part").withColumn(
        "split", F.when(F.col("_mode") == "all", "test").otherwise("train"))
    cols = df.columns + ["split"]
    return rest.select(*cols).unionByName(part.select(*cols))


def stratified_sample(seed, key, fraction) -> Column:
    """P19 (hash mode): keep a row with probability ``fraction`` (a number or a per-row column)."""
    f = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return hash_unit(seed, key, 2) < f
