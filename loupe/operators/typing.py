"""Whole-column type inference (P1) in two passes.

Pass 1 is ONE aggregate that computes, for every string column at once, the counts that
decide its type (missing, unparsable as float, ISO-date-shaped, unparsable as date).  Pass 2
is one ``select`` applying the chosen expression per column.  Typed columns skip pass 1:
numbers become doubles, dates and timestamps become day ordinals.

Decisions, in the reference's order: ``float`` if every non-missing value parses; (the strict
integer branch can never win after float, so integers are doubles); ``ordinal`` when at least
90 % of non-missing values have the ISO date shape and all of them parse; else ``float_nan``
(unparsable values become NaN).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions import clean

DATE_SHARE = 0.90  # fixed value: share of ISO-shaped values that makes a date column

_TEXT = (T.StringType, T.VarcharType, T.CharType)
_DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or df.columns
    fields = {f.name: f for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(cols):
        dt = fields[c].dataType
        miss = clean.is_missing(c)
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            miss = miss | F.isnan(F.col(c))
        aggs.append(F.count_if(miss).alias(f"m{i}"))
        if isinstance(dt, _TEXT):
            present = ~miss
            aggs += [
                F.count_if(present & clean.try_double(c).isNull()).alias(f"u{i}"),
                F.count_if(present & clean.iso_date_shape(c)).alias(f"iso{i}"),
                F.count_if(present & F.try_to_timestamp(F.trim(F.col(c))).isNull()).alias(f"du{i}"),
            ]
    aggs.append(F.count(F.lit(1)).alias("_n"))
    wide = df.agg(*aggs)
    n = F.col("_n")
    rows = []
    for i, c in enumerate(cols):
        dt = fields[c].dataType
        m = F.col(f"m{i}")
        if isinstance(dt, _TEXT):
            u, iso, du = F.col(f"u{i}"), F.col(f"iso{i}"), F.col(f"du{i}")
            present = n - m
            decision = (F.when(u == 0, F.lit("float"))
                        .when((present > 0) & (iso >= F.lit(DATE_SHARE) * present) & (du == 0), F.lit("ordinal"))
                        .otherwise(F.lit("float_nan")))
            unparsable = F.when(decision == "ordinal", F.lit(0)).otherwise(u)
        elif isinstance(dt, _DATES):
            decision, unparsable = F.lit("ordinal"), F.lit(0)
        else:
            decision, unparsable = F.lit("float"), F.lit(0)
        rows.append(F.struct(F.lit(c).alias("column_name"), decision.alias("decision"),
                             m.cast("bigint").alias("n_missing"), unparsable.cast("bigint").alias("n_unparsable")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def apply_types(df: DataFrame, decisions: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Pass 2: one projection with the chosen conversion per column (decisions: one row per column)."""
    chosen = {r["column_name"]: r["decision"] for r in decisions.collect()}
    fields = {f.name: f for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in keep or c not in chosen:
            out.append(F.col(c))
        else:
            out.append(clean.numeric_expr(fields[c], chosen[c]).alias(c))
    return df.select(*out)
