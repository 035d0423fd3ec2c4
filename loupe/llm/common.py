"""Helpers shared by the operators: staging in the cluster's shared folder, word patterns and a
join that spreads hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.session import checkpoint_dir, staged  # noqa: F401  (the operators take both from here)

#: White space and words as the result contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot from this share of all rows on, so there are at most 1/HOT_SHARE hot keys to broadcast.
HOT_SHARE = 1e-4
HOT_LEAST = 1000

#: Rows of an Arrow batch sent to Python; whole texts travel in them, so it is kept small.
BATCH_ROWS = 1000
BATCH_BYTES = "16m"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, as a batch is held in memory whole."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name under the folder that all executors share (spark.checkpoint.dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/loupe-{what}-{uuid.uuid4().hex}"


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def hot_limit(n_rows: int) -> int:
    return max(HOT_LEAST, int(n_rows * HOT_SHARE))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row a key, ``size`` its number of rows) that no hot
    key slows: groups over the hot limit are fewer than n_rows / limit, so they are broadcast; the
    rest meet on a shuffle of the key, where no key has more rows than the limit.  Keys are not null.
    Both sides are read twice, so pass staged tables."""
    limit = hot_limit(n_rows)
    hot, cold = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    spread = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return spread.unionByName(rest)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct whose field names cannot clash with others (c0, c1, ...)."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])


def row_hash(doc: str) -> Column:
    """A hash of a whole row, maps included (a tie means equal rows but for chance)."""
    return F.xxhash64(F.to_json(F.col(doc)))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the column doc (``whole_row``)."""
    return rows.select(*[F.col("doc")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def keep_once(docs: DataFrame, kept: DataFrame, digest: Column, id_col: str = "doc_id", digest_col: str = "text_sha256") -> DataFrame:
    """Rows of ``docs`` whose pair of id and ``digest`` (of their text) is in ``kept`` (``id_col``,
    ``digest_col``), one row for each pair; all columns stay, of any type and name.  A null id is an id:
    its rows differ by digest.  Of rows of one pair, the one with the smallest hash of all columns stays;
    they are combined before the shuffle, so a pair that many rows share is no large group."""
    pair = lambda c: F.concat_ws(":", F.col(id_col).cast("string"), c).alias("pair")  # noqa: E731  (without id: the digest alone)
    once = docs.select(pair(digest), whole_row(docs).alias("doc")).groupBy("pair").agg(F.min_by("doc", row_hash("doc")).alias("doc"))
    return unpacked(once.join(kept.select(pair(F.col(digest_col))), "pair", "left_semi"), docs)


def worker_store() -> dict:
    """A dict that lives as long as the Python worker, so that tasks of one worker can share memos
    (functions are sent by value, so their module globals do not outlive a task)."""
    import sys
    import types
    return sys.modules.setdefault("_loupe_worker_store", types.ModuleType("_loupe_worker_store")).__dict__
