"""Profiling (F1-F13): every statistic is one distributed aggregate over all columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions.text import words

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


_DESCRIBED = "column_name string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _stack(wide: DataFrame, names: list[str], fields: list[str], out: list[str], keep: list[str] = ()) -> DataFrame:
    """Unpivot ``wide`` (one row) with per-column fields ``{field}{i}`` into long form."""
    parts = ", ".join(f"'{n}', " + ", ".join(f"`{f}{i}`" for f in fields) for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {parts}) AS ({', '.join(out)})", *keep)


def shape(df: DataFrame) -> DataFrame:
    """rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def memory_usage(df: DataFrame) -> str:
    """optimizer size estimate formatted with B..PB suffix (no job is run)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue()
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    i = 0 if size <= 0 else min(int(math.log(size, 1024)), len(units) - 1)
    return f"{size / 1024 ** i:.1f} {units[i]}"


def head(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """first rows by key (deterministic)."""
    return df.orderBy(key).limit(n)


def datatypes(df: DataFrame) -> DataFrame:
    """F3."""
    return df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, data_type string")


SELECTION_BINS, SELECTION_ROWS = 1024, 100_000  # ranges a pass, and rows of a range that are ranked at once


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], bins: int = SELECTION_BINS,
                     most: int = SELECTION_ROWS) -> dict[tuple[str, int], float]:
    """The values at 0-based ``ranks`` of each column's sorted non-null values (as doubles, NaN largest).

    A pass counts the values in equal ranges and keeps, for each rank, the range that holds it, cut to the values
    that it really holds.  That repeats, on the rows of these ranges alone, until a range holds one value or at
    most ``most`` rows, which are then ranked.  A pass shuffles ranges, never rows, and narrows a range at least
    ``bins`` times, so values over many decades take more passes; a rank outside the column is an error."""
    cols = [c for c, r in ranks.items() if r]
    value = {i: F.col(f"`{c}`").cast("double") for i, c in enumerate(cols)}
    found: dict[tuple[str, int], float] = {}
    # (column, low, high) -> [(rank inside the range, rank in the column)]; None: not cut yet
    ranges: dict[tuple[int, float | None, float | None], list[tuple[int, int]]] = {
        (i, None, None): [(r, r) for r in sorted(set(ranks[c]))] for i, c in enumerate(cols)}
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != math.inf)
    if ranges:
        ends = df.agg(*[f(F.when(finite(x), x)).alias(f"{n}{i}") for i, x in value.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
        ranges = {(i, ends[f"lo{i}"], ends[f"hi{i}"]): held for (i, _, _), held in ranges.items()}
    first, small = True, {}
    while ranges:
        cells = []
        for j, (i, lo, hi) in enumerate(ranges):
            x = value[i]
            if lo is None or lo == hi:
                place = F.lit(0)
            else:  # halves: the difference of the ends may be more than a double holds
                place = F.least(F.floor((x * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5) * bins), F.lit(bins - 1)).cast("int")
            if first:
                place = F.when(F.isnan(x), bins + 1).when(x == math.inf, bins).when(x == -math.inf, -1).otherwise(place)
                inside = x.isNotNull()
            else:
                inside = (x >= lo) & (x <= hi)
            cells.append(F.when(inside, F.struct(F.lit(j).alias("j"), place.alias("b"), x.alias("x"))))
        hist = (df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*").groupBy("j", "b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("j", "b").collect())
        after: dict = {}
        for j, ((i, _, _), held) in enumerate(ranges.items()):
            before, mine = 0, [r for r in hist if r["j"] == j]
            if held[0][0] < 0 or held[-1][0] >= sum(r["n"] for r in mine):
                raise ValueError(f"column {cols[i]}: rank outside its {sum(r['n'] for r in mine)} values")
            for r in mine:
                inner = [(at - before, rank) for at, rank in held if before <= at < before + r["n"]]
                before += r["n"]
                if not inner:
                    continue
                if r["lo"] == r["hi"] or math.isnan(r["hi"]):
                    found |= {(cols[i], rank): r["hi"] for _, rank in inner}
                else:
                    (small if r["n"] <= most else after)[i, r["lo"], r["hi"]] = inner
        ranges, first = after, False
    if small:
        cells = [F.when((value[i] >= lo) & (value[i] <= hi), F.struct(F.lit(j).alias("j"), value[i].alias("x")))
                 for j, (i, lo, hi) in enumerate(small)]
        counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*").groupBy("j", "x").agg(F.count(F.lit(1)).alias("n"))
        asked = df.sparkSession.createDataFrame([(j, at, rank) for j, held in enumerate(small.values()) for at, rank in held],
                                                "j int, at long, rank long")
        upto = Window.partitionBy("j").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        hits = (counts.withColumn("c", F.sum("n").over(upto)).join(F.broadcast(asked), "j")
                .filter("at < c and at >= c - n").select("j", "rank", "x").collect())
        names = [cols[i] for i, _, _ in small]
        found |= {(names[r["j"]], r["rank"]): r["x"] for r in hits}
    return found


def quantiles(df: DataFrame, columns: list[str], counts: dict[str, int], shares=(0.25, 0.5, 0.75)) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of columns that have ``counts`` non-null values; None for none."""
    places = {c: [q * (counts[c] - 1) for q in shares] if counts[c] else [] for c in columns}
    values = order_statistics(df, {c: [r for p in ps for r in (math.floor(p), math.ceil(p))] for c, ps in places.items()})
    out: dict[str, list[float | None]] = {}
    for c, ps in places.items():
        out[c] = [None] * len(shares)
        for k, p in enumerate(ps):
            lo, hi = values[c, math.floor(p)], values[c, math.ceil(p)]
            out[c][k] = lo if lo == hi else lo + (hi - lo) * (p - math.floor(p))
    return out


def describe(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max of every numeric column.

    ``exact`` finds the quartiles by distributed selection (``order_statistics``); ``exact=False`` reads them
    from the mergeable ``percentile_approx`` sketch in the one aggregate of the rest."""
    cols = columns or numeric_columns(df)
    out_names = ["column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if not exact:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{i}"))
    if not cols:
        return df.sparkSession.createDataFrame([], _DESCRIBED)
    wide = df.agg(*aggs)
    if exact:
        row = wide.first()
        q = quantiles(df, cols, {c: row[f"n{i}"] for i, c in enumerate(cols)})
        return df.sparkSession.createDataFrame(
            [(c, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"lo{i}"], *q[c], row[f"hi{i}"]) for i, c in enumerate(cols)], _DESCRIBED)
    for i in range(len(cols)):
        wide = (wide.withColumn(f"a{i}", F.col(f"q{i}")[0]).withColumn(f"b{i}", F.col(f"q{i}")[1])
                .withColumn(f"c{i}", F.col(f"q{i}")[2]))
    return _stack(wide, cols, ["n", "m", "s", "lo", "a", "b", "c", "hi"], out_names)


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete), long form, one aggregate."""
    cols = columns or numeric_columns(df)
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                    for i, (a, b) in enumerate(pairs)])
    parts = ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {parts}) AS (col_a, col_b, corr)")


def skew(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """bias-corrected sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2)."""
    cols = columns or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.skewness(x).alias(f"g{i}"), F.count(x).alias(f"n{i}")]
    wide = df.agg(*aggs)
    for i in range(len(cols)):
        n = F.col(f"n{i}").cast("double")
        wide = wide.withColumn(f"k{i}", F.when(n > 2, F.col(f"g{i}") * F.sqrt(n * (n - 1)) / (n - 2)))
    return _stack(wide, cols, ["k"], ["column_name", "skew"])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """F7."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))


def smallest_class_size(df: DataFrame, label: str) -> DataFrame:
    """F8: size of the smallest labelled class, at least 1."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.greatest(F.lit(1), F.coalesce(F.min("n"), F.lit(1))).cast("bigint").alias("n_min"))


def cv_folds(n_min: int, test_size: float = 0.2, oversampling: bool = False, max_folds: int = 10) -> tuple[int, bool]:
    """number of CV folds from the smallest class size (keeps the reference's
    ``int(n_min*1.0 - test_size)``); with oversampling the folds are halved and oversampling
    is switched off when fewer than two remain."""
    k = min(max_folds, int(n_min * 1.0 - test_size))
    if oversampling:
        half = int(k / 2)
        if half < 2:
            return k, False
        return half, True
    return k, oversampling


def cv_folds_frame(df: DataFrame, label: str, test_size: float = 0.2, max_folds: int = 10) -> DataFrame:
    """F9 as a query: folds = least(max_folds, floor(n_min - test_size))."""
    return smallest_class_size(df, label).select(
        "n_min", F.least(F.lit(max_folds), F.floor(F.col("n_min") - F.lit(test_size))).cast("bigint").alias("n_folds"))


def lexical_richness(df: DataFrame, text_col: str) -> DataFrame:
    """number of words, number of distinct terms and type-token ratio over a text column.

    The distinct-term count is a grouped aggregate on the exploded words (partial aggregation
    keeps frequent words cheap), not a set built in one task.
    """
    w = df.select(F.explode(words(text_col)).alias("w"))
    per_term = w.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return per_term.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_words"),
                        F.count(F.lit(1)).cast("bigint").alias("n_terms")).select(
        "n_words", "n_terms",
        F.when(F.col("n_words") > 0, F.col("n_terms") / F.col("n_words")).alias("ttr"))


def drop_all_missing_columns(labelled: DataFrame, *others: DataFrame, keep: list[str] = ()):
    """drop columns with no value on any labelled row, from all frames alike."""
    cols = [c for c in labelled.columns if c not in keep]
    counts = labelled.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first().asDict()
    empty = [c for c, n in counts.items() if n == 0]
    return (labelled.drop(*empty), *[o.drop(*empty) for o in others], empty)


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """F12/F13 as a query: per column, rows that are null (or NaN for floating columns)."""
    cols = columns or df.columns
    aggs = []
    for i, c in enumerate(cols):
        f = df.schema[c].dataType
        miss = F.col(c).isNull()
        if isinstance(f, (T.FloatType, T.DoubleType)):
            miss = miss | F.isnan(F.col(c))
        aggs.append(F.count_if(miss).alias(f"m{i}"))
    wide = df.agg(*aggs, F.count(F.lit(1)).alias("_t"))
    return _stack(wide, cols, ["m"], ["column_name", "n_missing"], keep=["_t AS n_rows"]).select(
        "column_name", F.col("n_missing").cast("bigint").alias("n_missing"),
        F.col("n_rows").cast("bigint").alias("n_rows"),
        (F.col("n_missing") == F.col("n_rows")).alias("all_missing"))


def has_missing(df: DataFrame, columns: list[str]) -> bool:
    """any null/NaN among training features (a warning in the reference)."""
    m = missing_counts(df, columns).agg(F.max(F.col("n_missing") > 0).alias("x")).first()["x"]
    return bool(m)
