"""Line dedup by overlapping three-line windows.  Only DataFrame functions.

Each three consecutive lines make a window, keyed by the hash of the hashes of its lines (white space
in a line counts as one space).  Windows are counted over all documents with map-side combining;
of one that repeats, the first place (by document id and line) stays and every later one marks its
three lines.  The marked lines of a document, merged, are removed.  A removed line always has an
equal one at an earlier place, so each line's first place stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import SPACE, attach, staged

LINES = 3


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def _hashes(lines: Column) -> Column:
    """Hash of each line; nothing for a blank one."""
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    return F.transform(plain, lambda x: F.when(x != "", F.hex(F.xxhash64(x))).otherwise(F.lit("")))


def _windows(hashes: Column, n: int) -> Column:
    """(pos, joined hashes) of each window that has a line with more than white space."""
    starts = F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)).otherwise(F.array().cast("array<int>"))
    joined = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(hashes, i + 1, n), "|").alias("joined")))
    return F.filter(joined, lambda w: w["joined"] != "|" * (n - 1))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = LINES) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_removed, removed (the line numbers from 0, sorted) and
    text without them.

    A null text is one empty line.  Texts of fewer than ``n`` lines have no windows, and windows of
    blank lines only are not compared.  Rows that repeat id and text are one place and fare alike;
    rows of one id with different texts are ordered by the texts' hash; null ids come last.  An empty
    table gives an empty result; other columns of ``docs`` are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    places = staged(
        rows.select("id", "text_hash", _hashes(_lines("text")).alias("hashes"))
        .select("id", "text_hash", F.explode(_windows(F.col("hashes"), n)).alias("w"))
        .select("id", "text_hash", F.col("w.pos").alias("pos"), F.unhex(F.md5("w.joined")).alias("key")), "windows")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "pos")
    repeated = staged(places.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.count(F.lit(1)).alias("n"))
                      .where("first <> final").drop("final"), "repeated")
    later = attach(places, repeated, "key", "n", places.count()).where(place != F.col("first"))
    covered = (later.select("id", "text_hash", F.explode(F.sequence(F.col("pos"), F.col("pos") + n - 1)).alias("line"))
               .groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("removed"))
               .select(F.col("id").alias("in_id"), F.col("text_hash").alias("in_hash"), "removed"))
    met = rows.join(covered, F.col("id").eqNullSafe(F.col("in_id")) & (F.col("text_hash") == F.col("in_hash")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.when(F.size(removed) == 0, F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.filter(_lines("text"), lambda x, i: ~F.array_contains(removed, i)), "\n"))
    return met.select(F.col("id").alias(id_col), F.size(_lines("text")).cast("long").alias("n_lines"),
                      F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), kept.alias("text"))
