"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share the words of all
documents; a target stops at three times its source's size, and the excess goes to the other sources
by weight (the level that fills all caps is found from the sources sorted by cap / weight).

Schedule: while training runs from time 0 to 1, a source's share is its target times a density that
rises or falls linearly, 1 + slope * (2t - 1); its integral, the cumulative demand, is a quadratic of
t that is inverted in closed form.  A source is read in a fixed pseudo-random order, over again if its
target is larger than itself.  A copy of a document whose words begin at offset c of that reading is
due when the demand reaches c; its position is the demand of all sources at that time.

The offsets are prefix sums inside a source.  They come from sums over 4096 bins of the order key and
running sums within a bin, so a source that holds a third of all rows is 4096 groups of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.common import attach, row_hash, staged, unpacked, whole_row, word_count

#: Words of a source may be taken so often; weights by rank; slope of the density by weight.
REPEATS = 3
WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
#: Hex digits of the order key that make a bin: 4096 bins a source.
BIN_DIGITS = 3


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def mixing_targets(totals: DataFrame, weights=WEIGHTS, slopes=SLOPES, repeats: int = REPEATS) -> DataFrame:
    """totals(src, source, n_docs, source_size) with weight, slope, target, and the sums over all sources:
    all_words and all_slope (of target * slope).  One row a source: as long as the mixing plan itself."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    t = (totals.withColumn("rank", rank)
         .withColumn("place", ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
         .withColumns({"weight": _pick(weights, F.col("place")).cast("long"), "slope": _pick(slopes, F.col("place")).cast("double"),
                       "cap": F.col("source_size") * repeats}))
    # the level if this source and all after it in the order of cap / weight stay below their caps
    t = (t.withColumns({"words": F.sum("source_size").over(every), "order": F.row_number().over(by_fill)})
         .withColumns({"left_words": F.col("words") - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                       "left_weight": F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
         .withColumn("fits", big("left_words") * big("weight") <= big("cap") * big("left_weight")))
    level = F.min(F.when(F.col("fits"), F.struct("order", "left_words", "left_weight"))).over(every)
    t = t.withColumn("level", level).withColumn(
        "target", F.when(F.col("order") < F.col("level.order"), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * F.col("level.left_words")).cast("double") / F.col("level.left_weight").cast("double")))
    return t.select("src", "n_docs", "source_size", "weight", "slope", "target",
                    F.sum("target").over(every).alias("all_words"), F.sum(F.col("target") * F.col("slope")).over(every).alias("all_slope"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: id, text_hash, size (words), source_size, target (its source's), copies
    (0 to 3), taken (words, repeats counted) and positions (of each copy, in words from the start).

    A copy is taken if its middle word lies within the target, so a source's taken words come within
    one document of its target.  Null texts and texts without words have size 0 and are not taken;
    null sources are one source; null ids and repeated rows are rows like others.  The same input
    gives the same mix, however it is partitioned.  An empty table gives an empty result; other
    columns of ``docs`` are not read."""
    # the text parts rows that share an id, or have none
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = staged(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source"),
        F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source_col)).alias("src"),
        word_count(text_col).alias("size"), key.alias("key")).withColumn("bin", F.substring("key", 1, BIN_DIGITS)), "sizes")
    n_rows = rows.count()
    bins = staged(rows.groupBy("src", "bin").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bin_size")), "bins")
    before = F.sum("bin_size").over(Window.partitionBy("src").orderBy("bin")) - F.col("bin_size")
    bins_before = bins.select("src", "bin", before.alias("before"))
    in_bin = Window.partitionBy("src", "bin").orderBy("key", F.col("id").asc_nulls_last(), "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = staged(rows.withColumn("within", F.sum("size").over(in_bin) - F.col("size")).join(bins_before, ["src", "bin"])
                     .select("id", "text_hash", "src", "size", (F.col("before") + F.col("within")).alias("offset")), "offsets")
    totals = bins.groupBy("src").agg(F.max("source").alias("source"), F.sum("n").alias("n_docs"), F.sum("bin_size").alias("source_size"))
    planned = attach(offsets, staged(mixing_targets(totals), "targets"), "src", "n_docs", n_rows)

    def position(start: Column) -> Column:
        """Time at which the source's demand reaches ``start``, and the demand of all sources then."""
        share, slope = start / F.col("target"), F.col("slope")
        time = 2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))
        time = F.least(time, F.lit(1.0))
        return F.floor((F.col("all_words") - F.col("all_slope")) * time + F.col("all_slope") * time * time)

    starts = F.array(*[(F.lit(k) * F.col("source_size") + F.col("offset")).cast("double") for k in range(REPEATS)])
    due = F.filter(starts, lambda s: (F.col("size") > 0) & (2 * s + F.col("size") <= 2 * F.col("target")))
    return (planned.withColumn("due", due)
            .select(F.col("id").alias(id_col), "text_hash", "size", "source_size", "target", F.size("due").alias("copies"),
                    (F.size("due") * F.col("size")).alias("taken"), F.transform("due", position).alias("positions")))


def training_order(rows: DataFrame) -> DataFrame:
    """``rows`` with a column position, range-sorted by it."""
    return rows.repartitionByRange("position").sortWithinPartitions("position")


def mix_totals(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``mix`` with ``taken`` as the written training order holds it: every copy of a row is
    placed by its position, the schedule is range-sorted and written, and a row's words are summed from
    what is read back.  The schedule holds numbers, no texts."""
    mixed = mix(docs, id_col, **options)
    numbered = staged(mixed.withColumn("row", F.monotonically_increasing_id()), "mixed")
    copies = numbered.select("row", "size", F.explode("positions").alias("position"))
    schedule = staged(training_order(copies), "schedule")
    # the position is read back too
    read = schedule.where("position is not null").groupBy("row").agg(F.sum("size").alias("read"))
    return numbered.join(read, "row", "left").withColumn("taken", F.coalesce("read", F.lit(0)).cast("long")).drop("row", "read")


def in_training_order(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The taken documents, a row for each copy, range-sorted by position; the columns of ``docs``, of any
    type and name.  Rows of one id and text are told apart by nothing else: each copy is the row of the
    smallest hash of all columns."""
    taken = (mixed.where("copies > 0").select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash"), F.explode("positions").alias("position")))
    each = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_hash"), whole_row(docs).alias("doc"))
    each = each.groupBy("own_id", "own_hash").agg(F.min_by("doc", row_hash("doc")).alias("doc"))
    met = each.join(taken, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash")))
    return unpacked(training_order(met.select("doc", "position")), docs)
