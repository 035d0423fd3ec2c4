"""Exact k-nearest-neighbour join (K1) and the neighbour classifiers (A21 KNN, A22 radius neighbours).

The right side is cut into Voronoi cells of a few pivots (rows chosen by hash).  A cell keeps its
number of rows and the smallest and largest distance to its pivot, so the triangle inequality bounds
the distance from any left row to all rows of a cell.

1. Each left row meets the cells with the nearest pivots that hold enough rows between them; its
   k-th distance there is an upper bound.
2. It then meets the other cells whose lower bound does not exceed that; no other cell can hold a
   neighbour.  The result is exact.

Neighbouring cells make regions of about ``BLOCK_ROWS`` rows.  A left row is sent once to each region
where it visits a cell, so its vector is copied for every ``BLOCK_ROWS`` right rows at most, however
many cells there are.  A cell above that size is a region of several blocks by hash, and the left rows
that visit a block are split into parts too, so a cell that holds a third of all rows is many groups of
work.  A group compares a block and a part in numpy and returns each left row's k best; they are merged
with a grouped limit before the shuffle.  How many cells step 2 saves depends on the data: clustered
rows need few, rows without structure in many dimensions need nearly all of them (``pairs_compared``
tells), so the time can still grow with the square of the rows; the memory of a group does not grow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.session import staged

#: Rows of a block; pivots at most (the driver and each task hold them).
BLOCK_ROWS = 8192
PIVOTS_MOST = 1024
#: Left rows compared at once, visits of an Arrow batch, and pairs whose distances are summed at once.
LEFT_ROWS, VISITS, PAIRS = 256, 4096, 1 << 16


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 0))


def _nothing(columns) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([None], dtype=object) for c in columns}).iloc[:0]


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Text columns as plain objects, which Arrow takes at any length."""
    return frame.astype({c: object for c in frame.columns if not pd.api.types.is_numeric_dtype(frame[c])})


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of two small sets of rows, by inner products (see ``_exact`` for exact ones)."""
    return np.sqrt(_squares(a, b))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = a @ (-2 * b.T)
    d2 += (a * a).sum(axis=1)[:, None]
    d2 += (b * b).sum(axis=1)[None, :]
    return np.maximum(d2, 0, out=d2)


def _rounding(a: np.ndarray, b: np.ndarray) -> float:
    """More than the error of ``_squares``."""
    return 1e-9 * (1 + float((a * a).sum(axis=1).max(initial=0)) + float((b * b).sum(axis=1).max(initial=0)))


def _exact(a: np.ndarray, row: np.ndarray, b: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of the pairs (a[row], b[col])."""
    out = np.empty(len(row))
    for at in range(0, len(row), PAIRS):
        piece = slice(at, at + PAIRS)
        out[piece] = np.sqrt(((b[col[piece]] - a[row[piece]]) ** 2).sum(axis=1))
    return out


def _regions(pivots: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """A number for each cell; cells of one number are neighbours and hold at most ``most`` rows, or are one
    cell.  Halves by rows along the widest coordinate."""
    out, open_, made = np.zeros(len(pivots), int), [np.arange(len(pivots))], 0
    while open_:
        cells = open_.pop()
        if len(cells) == 1 or count[cells].sum() <= most:
            out[cells], made = made, made + 1
            continue
        along = pivots[cells, np.ptp(pivots[cells], axis=0).argmax()]
        cells = cells[np.argsort(along, kind="stable")]
        held = np.cumsum(count[cells])
        cut = min(max(1, int(np.searchsorted(held, held[-1] / 2))), len(cells) - 1)
        open_ += [cells[:cut], cells[cut:]]
    return out


class Cells:
    """Pivots and what is known of each cell's rows: count, least and largest distance to the pivot.  Cells
    belong to regions, and a region has blocks."""

    def __init__(self, pivots: np.ndarray, count: np.ndarray, near: np.ndarray, far: np.ndarray):
        self.pivots, self.count, self.near, self.far = pivots, count, near, far
        self.region = _regions(pivots, count, BLOCK_ROWS)
        self.rows = np.bincount(self.region, weights=count).astype(int)
        self.blocks = np.maximum(1, -(-self.rows // BLOCK_ROWS)).astype(int)
        self.slack = 1e-7 * (1 + float(np.abs(pivots).max(initial=0)) * math.sqrt(pivots.shape[1] or 1))

    def first(self, d: np.ndarray, k: int) -> list[np.ndarray]:
        """The cells that step 1 visits for each row: those of the nearest pivots until they hold k rows."""
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1)
        take = (held - self.count[order] < k) & (self.count[order] > 0)
        return [cells[some].astype("int32") for cells, some in zip(order, take)]

    def within(self, d: np.ndarray, reach: np.ndarray, which=slice(None)) -> np.ndarray:
        """Which cells may hold a row within ``reach``."""
        least = np.maximum(np.maximum(d - self.far[which], self.near[which] - d), 0)
        return (least <= reach[:, None] + self.slack) & (self.count[which] > 0)

    def mask(self, lists) -> np.ndarray:
        """Rows x cells: which cells each row's list names."""
        out = np.zeros((len(lists), len(self.pivots)), bool)
        for i, some in enumerate(lists):
            out[i, some] = True
        return out


def _by_number(values: np.ndarray, number: str):
    """The value of a column that counts from 0."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(number) + 1)


def _cells(right: DataFrame, seed: int) -> tuple[Cells, DataFrame]:
    """Cells of right(_rid, _rx, ...), and the rows with their cell, region and block."""
    n = right.count()
    n_pivots = max(1, min(PIVOTS_MOST, math.isqrt(n)))
    chosen = right.select("_rx", F.xxhash64("_rid", F.lit(seed)).alias("h")).orderBy("h").limit(n_pivots).collect()
    pivots = np.unique(_matrix([r["_rx"] for r in chosen]), axis=0) if chosen else np.zeros((1, 1))

    @F.pandas_udf("cell int, reach double")
    def own_cell(x: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(x), pivots) if len(x) else np.zeros((0, 1))
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": d[np.arange(len(d)), cell]})

    rows = staged(right.withColumn("_c", own_cell("_rx")).select("*", F.col("_c.cell").alias("_cell"), F.col("_c.reach").alias("_reach")).drop("_c"), "cells")
    count, near, far = np.zeros(len(pivots), int), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_reach").alias("a"), F.max("_reach").alias("b")).collect():
        count[r["_cell"]], near[r["_cell"]], far[r["_cell"]] = r["n"], r["a"], r["b"]
    cells = Cells(pivots, count, near, far)
    rows = rows.withColumn("_region", _by_number(cells.region, "_cell"))
    return cells, rows.withColumn("_block", F.pmod(F.xxhash64("_rid", F.lit("block")), _by_number(cells.blocks, "_region")).cast("int")).drop("_reach")


def _visits(left: DataFrame, cells: Cells, choose, carried: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """left(_lid, _lx, ``carried``) and its nearest cell, once for each (region, block) that holds a cell which
    ``choose(distances to pivots, batch)`` picks, a bounded batch of visits at a time; and how many rows
    visit each region."""
    names = ("_lid", "_lx", *carried)
    schema = T.StructType([*[left.schema[c] for c in names], *[T.StructField(c, T.IntegerType()) for c in ("_home", "_region", "_block")]])
    blocks, n_regions = cells.blocks, len(cells.blocks)
    member = np.zeros((len(cells.pivots), n_regions), np.float32)
    member[np.arange(len(cells.pivots)), cells.region] = 1

    def picked(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                d = _distances(_matrix(part["_lx"]), cells.pivots)
                yield part, d.argmin(axis=1), (choose(d, part).astype(np.float32) @ member) > 0

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((regions.sum(axis=0) for _, _, regions in picked(batches)), np.zeros(n_regions, int))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"_region": some.astype("int32"), "n": total[some].astype(int)})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, home, regions in picked(batches):
            row, region = np.nonzero(regions)
            n = blocks[region]
            block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, region = np.repeat(row, n), np.repeat(region, n)
            for lo in range(0, len(row), VISITS):
                some = row[lo:lo + VISITS]
                yield _plain(pd.DataFrame({**{c: part[c].to_numpy()[some] for c in names}, "_home": home[some].astype("int32"),
                                           "_region": region[lo:lo + VISITS].astype("int32"), "_block": block[lo:lo + VISITS].astype("int32")}))

    visitors = np.zeros(n_regions, int)
    for r in left.mapInPandas(tally, "_region int, n long").groupBy("_region").agg(F.sum("n").alias("n")).collect():
        visitors[r["_region"]] = r["n"]
    return left.mapInPandas(visit, schema), visitors


def _meet(visits: tuple[DataFrame, np.ndarray], rows: DataFrame, fn, schema) -> DataFrame:
    """Group the visits of each block with its rows; many visits of one block are split by hash, and the
    block is repeated for each part."""
    asked, visitors = visits
    parts = np.maximum(1, -(-visitors // BLOCK_ROWS))
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("_lid", F.lit("part")), _by_number(parts, "_region")).cast("int"))
    held = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), _by_number(parts, "_region") - 1)))
    key = ("_region", "_block", "_part")
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(fn, schema)


def _nearest(k: int, exclude_self: bool, right_cols: tuple[str, ...], cells: Cells, later: bool):
    def nearest(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """The k nearest rows of this block for each visitor, ties to the smaller id: in the visitor's first
        cells, or (``later``) in the others, as far as its reach."""
        asked, place, dist = [], [], []
        if len(q) and len(x):
            x, q = x.sort_values("_rid", kind="stable"), q.sort_values("_home", kind="stable")
            qs, xs, ids, lids = _matrix(q["_lx"]), _matrix(x["_rx"]), x["_rid"].to_numpy(), q["_lid"].to_numpy()
            here, own = np.unique(x["_cell"].to_numpy(), return_inverse=True)
            scale = _rounding(qs, xs)
            for at in range(0, len(q), LEFT_ROWS):
                mine = slice(at, at + LEFT_ROWS)
                some = cells.mask(q["_first"].iloc[mine])[:, here]
                worth = some
                if later:
                    reach, some = q["_reach"].to_numpy()[mine], ~some
                    worth = some & cells.within(_distances(qs[mine], cells.pivots[here]), reach, here)
                cols = np.flatnonzero(worth.any(axis=0)[own])
                if not len(cols):
                    continue
                d2 = _squares(qs[mine], xs[cols])
                d2[~some[:, own[cols]]] = np.inf
                if later and np.isfinite(reach).all():
                    bound = reach ** 2 + scale
                else:
                    most = min(len(cols), k + 1)
                    bound = np.partition(d2, most - 1, axis=1)[:, most - 1] + scale
                row, col = np.nonzero((d2 <= bound[:, None]) & (d2 < np.inf))
                col = cols[col]
                if exclude_self:
                    other = ids[col] != lids[at + row]
                    row, col = row[other], col[other]
                exact = _exact(qs, at + row, xs, col)
                order = np.lexsort((col, exact, row))
                row, col, exact = row[order], col[order], exact[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                asked.append(at + row[best])
                place.append(col[best])
                dist.append(exact[best])
        if asked:
            where = np.concatenate(place)
            return _plain(pd.DataFrame({"_lid": lids[np.concatenate(asked)], "_rid": ids[where], "_d": np.concatenate(dist),
                                        **{c: x[c].to_numpy()[where] for c in right_cols}}))
        return _nothing(("_lid", "_rid", "_d", *right_cols))
    return nearest


def _sides(left: DataFrame, right: DataFrame, left_id: str, right_id: str, x: str, right_cols=()) -> tuple[DataFrame, DataFrame]:
    return (left.select(F.col(left_id).alias("_lid"), F.col(x).alias("_lx")),
            right.select(F.col(right_id).alias("_rid"), F.col(x).alias("_rx"), *right_cols))


def knn_join(left: DataFrame, right: DataFrame, k: int, left_id: str = "id", right_id: str = "id",
             x: str = "x", exclude_self: bool = False, seed: int = 7, right_cols: tuple[str, ...] = (),
             stats: dict | None = None) -> DataFrame:
    """Rows (left id, right id, dist, rank 1..k, right_cols...) for the k nearest right rows, ties to
    the smaller right id.

    ``x`` is an array<double> column on both sides; ids are unique and not null.  ``exclude_self`` drops
    pairs with equal ids (a self-join leaving the row out).  ``stats`` receives pairs_compared
    (at most) and rows_sent (copies of left rows)."""
    lefts, rights = _sides(left, right, left_id, right_id, x, right_cols)
    cells, rows = _cells(rights, seed)
    enough = k + (1 if exclude_self else 0)
    schema = T.StructType([T.StructField("_lid", lefts.schema["_lid"].dataType), T.StructField("_rid", rights.schema["_rid"].dataType),
                           T.StructField("_d", T.DoubleType()), *[rights.schema[c] for c in right_cols]])
    place = Window.partitionBy("_lid").orderBy("_d", "_rid")

    def best(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    @F.pandas_udf("array<int>")
    def first(x: pd.Series) -> pd.Series:
        out = [c for at in range(0, len(x), 512) for c in cells.first(_distances(_matrix(x.iloc[at:at + 512]), cells.pivots), enough)]
        return pd.Series(out, dtype=object)

    # written with the rows: both steps go by the same cells, so no pair is met twice or left out
    lefts = staged(lefts.withColumn("_first", first("_lx")), "left")
    first_visits = _visits(lefts, cells, lambda _, part: cells.mask(part["_first"]), ("_first",))
    found = staged(best(_meet(first_visits, rows, _nearest(k, exclude_self, right_cols, cells, False), schema)).drop("rank"), "nearest")
    reach = found.groupBy("_lid").agg(F.when(F.count(F.lit(1)) >= k, F.max("_d")).otherwise(F.lit(float("inf"))).alias("_reach"))
    waiting = staged(lefts.join(reach, "_lid", "left").withColumn("_reach", F.coalesce("_reach", F.lit(float("inf")))), "left")
    more_visits = _visits(waiting, cells, lambda d, part: cells.within(d, part["_reach"].to_numpy()) & ~cells.mask(part["_first"]), ("_first", "_reach"))
    more = _meet(more_visits, rows, _nearest(k, exclude_self, right_cols, cells, True), schema)
    if stats is not None:
        sizes = np.ceil(cells.rows / cells.blocks) * cells.blocks
        stats["pairs_compared"] = float((sizes * (first_visits[1] + more_visits[1])).sum())
        stats["rows_sent"] = int((cells.blocks * (first_visits[1] + more_visits[1])).sum())
    return best(found.unionByName(more)).select(
        F.col("_lid").alias(f"left_{left_id}"), F.col("_rid").alias(f"right_{right_id}"), F.col("_d").alias("dist"), "rank", *right_cols)


def radius_votes(left: DataFrame, right: DataFrame, radius: float, label: str, left_id: str = "id", right_id: str = "id",
                 x: str = "x", seed: int = 7) -> DataFrame:
    """(left id, label, n): how many right rows of each label lie within ``radius``.  Only cells that may
    hold such rows are visited, and a block's votes are counted before the shuffle."""
    lefts, rights = _sides(left, right, left_id, right_id, x, (label,))
    lefts = staged(lefts, "left")
    cells, rows = _cells(rights, seed)

    def votes(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            qs, xs = _matrix(q["_lx"]), _matrix(x["_rx"])
            names, codes = np.unique(x[label].to_numpy(), return_inverse=True)
            one_hot, scale, lids = np.eye(len(names))[codes], _rounding(qs, xs), q["_lid"].to_numpy()
            for at in range(0, len(q), LEFT_ROWS):
                d2 = _squares(qs[at:at + LEFT_ROWS], xs)
                near = d2 <= radius ** 2
                row, col = np.nonzero(np.abs(d2 - radius ** 2) <= scale)
                near[row, col] = _exact(qs, at + row, xs, col) <= radius
                n = near.astype(float) @ one_hot
                row, col = np.nonzero(n)
                out.append(pd.DataFrame({"_lid": lids[at + row], label: names[col], "n": n[row, col].astype(int)}))
        return _plain(pd.concat(out)) if out else _nothing(("_lid", label, "n"))

    schema = T.StructType([T.StructField("_lid", lefts.schema["_lid"].dataType), rights.schema[label], T.StructField("n", T.LongType())])
    visits = _visits(lefts, cells, lambda d, part: cells.within(d, np.full(len(part), radius)))
    return (_meet(visits, rows, votes, schema).groupBy(F.col("_lid").alias(f"left_{left_id}"), label).agg(F.sum("n").alias("n")))


class KnnFitted:
    """Lazy model: the training rows themselves."""

    def __init__(self, train: DataFrame, k: int, n_neighbors: int = 5, radius: float | None = None):
        # row numbers are written with the rows, so they do not change when something is recomputed
        self.train = staged(train.select(F.monotonically_increasing_id().alias("_tid"),
                                         vector_to_array(F.col("features")).alias("x"), F.col("label_idx").alias("_y")), "train")
        self.k, self.n, self.radius = k, n_neighbors, radius
        self.has_probability = True
        counts = self.train.groupBy("_y").count().orderBy(F.col("count").desc(), "_y").first()
        self.most_frequent = float(counts["_y"])

    def transform(self, df: DataFrame) -> DataFrame:
        q = staged(df.drop("prediction", "probability").withColumn("_qid", F.monotonically_increasing_id()), "asked")
        qx = q.select("_qid", vector_to_array(F.col("features")).alias("x"))
        if self.radius is None:
            nn = knn_join(qx, self.train, self.n, "_qid", "_tid", right_cols=("_y",)).withColumn("n", F.lit(1))
        else:
            nn = radius_votes(qx, self.train, self.radius, "_y", "_qid", "_tid")
        votes = nn.groupBy("left__qid").agg(
            *[F.sum(F.when(F.col("_y") == float(c), F.col("n")).otherwise(0)).alias(f"v{c}") for c in range(self.k)],
            F.sum("n").alias("_n"))
        share = F.array(*[F.col(f"v{c}") / F.col("_n") for c in range(self.k)])
        votes = votes.select(F.col("left__qid").alias("_qid"), share.alias("probability"))
        out = q.join(votes, "_qid", "left")
        fallback = F.array(*[F.lit(1.0 if c == int(self.most_frequent) else 0.0) for c in range(self.k)])
        out = out.withColumn("probability", F.coalesce(F.col("probability"), fallback))
        m = F.array_max("probability")
        return out.withColumn("prediction", (F.array_position("probability", m) - 1).cast("double")).drop("_qid")


def fit_knn_classifier(train: DataFrame, k: int, radius: bool = False, n_neighbors: int = 5, r: float = 1.0, **_):
    return KnnFitted(train, k, n_neighbors, r if radius else None)
