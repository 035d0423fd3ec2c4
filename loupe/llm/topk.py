"""Exact top-k search by integer inner product with a three-phase uniform threshold.

The components of all vectors are cut into a few lists (ranges of components); a vector's score is
the sum of its local scores in the lists.

1. Each list names every query's k best local scores.  The vectors named are scored exactly; the k-th
   best of them is a safe cutoff T: no vector below T can be in the result.
2. T goes back to all lists.  A vector of score T or more has a local score of T / lists or more in
   some list, so the lists send all entries from there on, but for those that cannot reach T: what the
   other lists can add is at most the product of the norms of both vectors there (Cauchy-Schwarz).
3. Vectors that some list did not send get their missing parts; the k best scores are the result.

Lists are worked on as a grid of blocks of vectors by blocks of queries, so a task holds two blocks.
Of equal vectors only the k + 1 with the smallest ids can be in a result (scores tie, and ties go to
the smaller id), so a vector that a third of all rows share costs k + 1 rows.  A row is named by a
number of its own, so an id may stand with several vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.common import staged

LISTS = 2
ROW_BLOCK = 8192
QUERY_BLOCK = 8192
#: Queries scored at a time in a task: QUERIES_AT_ONCE x ROW_BLOCK scores are held.
QUERIES_AT_ONCE = 256
ENTRY = "query_row long, query_id long, row long, vec_id long, list int, local long"
NO_ENTRIES = dict.fromkeys(["query_row", "query_id", "row", "vec_id", "list", "local"], [])


def quantised(vec: str, scale: int) -> Column:
    return F.transform(F.col(vec), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vec: str) -> Column:
    """A vector takes part if neither it nor a component is null, infinite or no number."""
    finite = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vec).isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of a list's components; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column):
        out[i, :len(row)] = row
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where none can exceed 2**53, else in integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if most < 2**53 else q @ x.T


def _entries(q: pd.DataFrame, at: np.ndarray, x: pd.DataFrame, col: np.ndarray, local: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_row": q["row"].to_numpy()[at], "query_id": q["id"].to_numpy()[at], "row": x["row"].to_numpy()[col], "vec_id": x["id"].to_numpy()[col],
                         "list": int(x["list"].iloc[0]), "local": local})


def _local_best(k: int, width: int):
    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """Each query's k best local scores in this block."""
        out, ids = [], x["id"].to_numpy()
        if len(q) and len(x):
            xs = _matrix(x["part"], width)
            for at in range(0, len(q), QUERIES_AT_ONCE):
                some = q.iloc[at:at + QUERIES_AT_ONCE]
                for i, scores in enumerate(_products(_matrix(some["part"], width), xs)):
                    scores = scores[other := np.flatnonzero(ids != some["id"].iloc[i])]
                    top = np.argpartition(-scores, k - 1)[:k] if len(scores) > k else np.arange(len(scores))
                    out.append(_entries(some, np.full(len(top), i), x, other[top], scores[top]))
        return pd.concat(out) if out else pd.DataFrame(NO_ENTRIES, dtype="int64")
    return best


def _above_cutoff(lists: int, width: int):
    def above(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """All entries of local score T / lists or more that can reach T; without a cutoff, all entries."""
        out, ids = [], x["id"].to_numpy()
        if len(q) and len(x):
            xs, rest = _matrix(x["part"], width), x["rest"].to_numpy()
            for at in range(0, len(q), QUERIES_AT_ONCE):
                some = q.iloc[at:at + QUERIES_AT_ONCE]
                scores = _products(_matrix(some["part"], width), xs)
                cutoff = np.array([-2**62 if pd.isna(t) else int(t) for t in some["cutoff"]])[:, None]
                most = scores + np.outer(some["rest"].to_numpy(), rest) * (1 + 1e-9) + 1.0  # rounding only raises the bound
                row, col = np.nonzero((scores >= -(-cutoff // lists)) & (most >= cutoff) & (some["id"].to_numpy()[:, None] != ids[None, :]))
                out.append(_entries(some, row, x, col, scores[row, col]))
        return pd.concat(out) if out else pd.DataFrame(NO_ENTRIES, dtype="int64")
    return above


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, lists: int = LISTS, id_col: str = "vec_id",
                vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row whose id is divisible by ``every``, the k rows of
    the highest inner products of the vectors floor(scale * x), ties to the smaller id; all if fewer.

    Rows without id or whose vector is null or holds a null or non-finite component take no part.  Rows
    that repeat id and vector count once, an id with several vectors is several candidates (and several
    queries, whose rows are ranked together); rows that share the query's id are the query's own.
    Shorter vectors count as filled up with zeros, empty ones score 0.  An empty table gives an
    empty result; other columns are not read.  Scores must fit into a long."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), quantised(vec_col, scale).alias("vec")).distinct()
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # written, so a row keeps its number
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    dims = max(dims or 1, 1)
    width = -(-dims // lists)
    lists = -(-dims // width)
    equal = Window.partitionBy("vec").orderBy("id")
    pool = staged(rows.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= k + 1).drop("place"), "pool")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    n_queries = queries.count()
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))

    def square(vec) -> Column:
        return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x)

    def cut(side: DataFrame, *keep: str) -> DataFrame:
        """A row for each list: its components of the vector, and the norm of all others."""
        part = lambda j: F.slice("vec", j * width + 1, width)
        rest = lambda j: F.sqrt(sum((square(part(i)) for i in range(lists) if i != j), F.lit(0.0)))
        cuts = F.explode(F.array(*[F.struct(F.lit(j).alias("list"), part(j).alias("part"), rest(j).alias("rest")) for j in range(lists)]))
        return side.select("id", "row", *keep, cuts.alias("cut")).select("id", "row", *keep, "cut.*")

    def blocks(side: DataFrame, name: str, n_blocks: int, other: str, n_other: int) -> DataFrame:
        """Its own block by hash, and a copy for each block of the other side."""
        own = F.pmod(F.xxhash64("row", F.lit(name)), F.lit(n_blocks)).cast("int")
        return side.withColumn(name, own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    lists_of_rows = blocks(cut(pool), "row_block", row_blocks, "query_block", query_blocks)
    grid = ("list", "row_block", "query_block")

    def scan(asked: DataFrame, keep: tuple, fn) -> DataFrame:
        asked = blocks(cut(asked, *keep), "query_block", query_blocks, "row_block", row_blocks)
        return asked.groupBy(*grid).cogroup(lists_of_rows.groupBy(*grid)).applyInPandas(fn, ENTRY)

    names = ["query_row", "query_id", "row", "vec_id"]

    def scored(pairs: DataFrame) -> DataFrame:
        """Exact scores of ``names``."""
        product = F.aggregate(F.zip_with("query_vec", "vec", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))),
                              F.lit(0).cast("long"), lambda s, x: s + x)
        return (pairs.join(pool.select("row", "vec"), "row").join(queries.select(F.col("row").alias("query_row"), F.col("vec").alias("query_vec")), "query_row")
                .select(*names, product.alias("score")))

    def best(of: DataFrame, by: list, order: list) -> DataFrame:
        return of.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)

    # 1: local score lists, and the cutoff from the exact scores of what they name
    named = best(scan(queries, (), _local_best(k, width)), ["query_row", "list"], [F.desc("local"), "vec_id", "row"])
    first = best(scored(named.select(*names).distinct()), ["query_row"], [F.desc("score"), "vec_id", "row"])
    cutoffs = first.groupBy("query_row").agg(F.when(F.max("rank") >= k, F.min("score")).alias("cutoff"))
    asked = staged(queries.join(cutoffs.withColumnRenamed("query_row", "row"), "row", "left"), "cutoffs")
    # 2: all entries from the cutoff on
    sent = scan(asked, ("cutoff",), _above_cutoff(lists, width))
    known = staged(sent.groupBy(*names).agg(F.sum("local").alias("score"), F.count(F.lit(1)).alias("lists")), "sent")
    # 3: the remaining scores
    whole = known.where(F.col("lists") == lists).select(*names, "score")
    resolved = scored(known.where(F.col("lists") < lists).select(*names))
    return best(whole.unionByName(resolved), ["query_id"], [F.desc("score"), "vec_id", "row"]).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")
