"""SimHash near-dedup: fingerprints linked by a self-join of a binary trie.

The distinct fingerprints form a binary trie.  Its upper part is cut at nodes of about equal size;
every pair of such nodes whose prefixes differ in no more bits than allowed becomes one group of
work.  Within a group, pairs of nodes are walked down together from the common depth: the
differing bits add up, and a pair whose sum exceeds the bound is dropped with all below it.
A group returns a spanning forest of the links it found, never all pairs, and the forests are
joined to components over the cluster.  Rows of equal fingerprints are one trie leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import attach, small_batches, staged
from loupe.llm.components import components

BITS = 64
SEED = 42
#: Most fingerprints of a trie node that is a unit of work, and the share of all that a node may hold.
NODE_MOST = 1 << 18
NODE_SHARE = 16
#: Node pairs of up to this many combinations are compared directly; pairs walked at a time.
DIRECT = 48
WALK = 1 << 14


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the word shingles (signed 64 bits): A-Z lower-cased, words split at white space,
    repeats counted; a text shorter than a shingle is one shingle, one without words gives 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:len(words) - shingle + 1].tolist()
        ends = ends[shingle - 1:].tolist()
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), 8192):
        part = [digest(joined[a:b], 42) for a, b in zip(starts[k:k + 8192], ends[k:k + 8192])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint_column(text_col: str, shingle: int):
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    return fingerprints(F.col(text_col))


# ---------------------------------------------------------------- trie walk within a group of work

class Forest:
    """Union of links over positions 0..n-1, in vectorised rounds."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        x = self.parent[x]
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            self.parent[a], self.parent[b] = ra, rb
            apart = ra != rb
            a, b = ra[apart], rb[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            self.parent[high] = low  # one of the links of each root wins; the rest go another round


def _spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], lo[i]+1, ... n[i] of them, for all i."""
    total = np.cumsum(n)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(lo - (total - n), n)


def _mid(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """First place in [lo, hi) whose bit at ``depth`` is set; keys[lo:hi] share the bits before."""
    shift = np.uint64(BITS - 1 - depth)
    first = (keys[lo] >> shift | np.uint64(1)) << shift
    return np.clip(np.searchsorted(keys, first), lo, hi)


def walk_links(a: np.ndarray, b: np.ndarray, same: bool, depth: int, budget: int, forest: Forest, offset: int) -> None:
    """Link the entries of the sorted key arrays that differ in at most ``budget`` bits.  ``depth``:
    bits that all keys of a, and all of b, share.  Positions of b start at ``offset`` in the forest."""
    if not len(a) or not len(b):
        return
    mask = ~np.uint64((1 << (BITS - depth)) - 1)
    diff = int(np.bitwise_count((a[0] ^ b[0]) & mask))
    if diff > budget:
        return
    one = lambda x: np.array([x], np.int64)
    stack = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(diff))]
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        if len(al) > WALK:
            half = len(al) // 2
            stack += [(depth, *(x[:half] for x in (al, ah, bl, bh, diff))), (depth, *(x[half:] for x in (al, ah, bl, bh, diff)))]
            continue
        small = ((ah - al) * (bh - bl) <= DIRECT) | (depth == BITS)
        if small.any():
            n_a, n_b = (ah - al)[small], (bh - bl)[small]
            left = _spans(al[small], n_a)
            right_lo, right_n = np.repeat(bl[small], n_a), np.repeat(n_b, n_a)
            left, right = np.repeat(left, right_n), _spans(right_lo, right_n)
            near = np.bitwise_count(a[left] ^ b[right]) <= budget
            if same:
                near &= left < right
            forest.add(left[near], right[near] + offset)
            al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        am, bm = _mid(a, al, ah, depth), _mid(b, bl, bh, depth)
        kids = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1)]
        cross = (am, ah, bl, bm, diff + 1)
        if same:  # below a node paired with itself, (right, left) repeats (left, right)
            twin = (al == bl) & (ah == bh)
            cross = tuple(x[~twin] for x in cross)
        kids.append(cross)
        cols = [np.concatenate(x) for x in zip(*kids)]
        go_on = (cols[0] < cols[1]) & (cols[2] < cols[3]) & (cols[4] <= budget)
        if go_on.any():
            stack.append((depth + 1, *(x[go_on] for x in cols)))


# ---------------------------------------------------------------- the trie's upper part

def _cut(distinct: DataFrame, n: int) -> list[tuple[int, int]]:
    """Nodes (prefix as a left-aligned number, depth) that cover all fingerprints, each of at most
    ``most`` of them.  Eight levels of counts at a time, only below nodes that are too large, so the
    driver sees of the order of 256 * n / most counts."""
    most = max(1, min(NODE_MOST, n // NODE_SHARE))
    done, open_, depth = [], [0], 0
    while open_:
        step = depth + 8
        below = distinct.select(F.shiftrightunsigned("fp", BITS - step).alias("head") if step < BITS else F.col("fp").alias("head"))
        if depth:
            opened = distinct.sparkSession.createDataFrame([(x,) for x in open_], "up long")
            below = below.join(F.broadcast(opened), F.shiftrightunsigned("head", 8) == F.col("up"), "left_semi")
        counts = {int(r[0]) & (2**BITS - 1): r[1] for r in below.groupBy("head").count().collect()}
        parents, open_ = open_, []

        def settle(prefix: int, at: int, found: dict) -> None:
            size = sum(found.values())
            if not size:
                return
            if size <= most or at == BITS:
                done.append((prefix << (BITS - at), at))
            elif at == step:
                open_.append(prefix)
            else:
                bit = step - at - 1
                for side in (0, 1):
                    settle(prefix << 1 | side, at + 1, {k: v for k, v in found.items() if k >> bit & 1 == side})

        by_parent: dict[int, dict] = {p: {} for p in parents}
        for k, v in counts.items():
            by_parent[k >> 8][k] = v
        for p, found in by_parent.items():
            settle(p, depth, found)
        depth = step
    return sorted(done)


def links(distinct: DataFrame, budget: int) -> DataFrame:
    """Links (u, v) between fingerprints of ``distinct`` (column fp, no repeats) that differ in at most
    ``budget`` bits, thinned to a spanning forest in each group of work: components stay the same."""
    n = distinct.count()
    if n < 2:
        return distinct.sparkSession.createDataFrame([], "u long, v long")
    nodes = _cut(distinct, n)
    starts = np.array([p for p, _ in nodes], np.uint64)
    depths = np.array([d for _, d in nodes], np.int64)
    heads = np.array([(1 << BITS) - (1 << (BITS - d)) for _, d in nodes], np.uint64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each fingerprint to all pairs of nodes that its node has a part in."""
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            own = np.searchsorted(starts, fp, side="right") - 1
            for node in np.unique(own):
                common = np.minimum(heads, heads[node])
                partners = np.flatnonzero(np.bitwise_count((starts ^ starts[node]) & common) <= budget)
                mine = fp[own == node].view(np.int64)
                pair = np.minimum(partners, node) * len(starts) + np.maximum(partners, node)
                yield pd.DataFrame({"pair": np.repeat(pair, len(mine)), "fp": np.tile(mine, len(pair))})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = divmod(int(pdf["pair"].iloc[0]), len(starts))
        fp = np.sort(pdf["fp"].to_numpy().view(np.uint64))
        own = np.searchsorted(starts, fp, side="right") - 1
        a, b = fp[own == first], fp[own == second]
        depth = int(min(depths[first], depths[second]))
        if first == second:
            keys, forest = a, Forest(len(a))
            walk_links(a, a, True, depth, budget, forest, 0)
        else:
            keys, forest = np.concatenate([a, b]), Forest(len(a) + len(b))
            walk_links(a, b, False, depth, budget, forest, len(a))
        place = np.arange(len(keys))
        root = forest.find(place)
        tied = root != place
        return pd.DataFrame({"u": keys[tied].view(np.int64), "v": keys[root[tied]].view(np.int64)})

    dealt = distinct.select("fp").mapInPandas(deal, "pair long, fp long")
    return dealt.groupBy("pair").applyInPandas(join, "u long, v long")


def text_digest(text_col: str) -> Column:
    """SHA-256 of the text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def near_duplicates(docs: DataFrame, shingle: int = 5, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fp (64 bits as a long), component_id (smallest id of the
    documents reachable by links of at most ``max_bits`` differing bits, itself included).

    Null and empty texts have fingerprint 0 and are linked like any other.  Rows without id are
    members but never name a component; one of such rows only has a null component_id.  Repeated
    rows are repeated in the result, an empty table gives an empty one, and other columns of
    ``docs`` are not read.  Whole texts are hashed, whatever their length."""
    prints = docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, shingle).alias("fp"))
    return _grouped(prints, max_bits).select(F.col("id").alias(id_col), "fp", "component_id")


def near_groups(docs: DataFrame, shingle: int = 5, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As near_duplicates, with text_sha256 (``text_digest``) and group_fp, a fingerprint that names the
    component also where ids are null or repeated."""
    prints = docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("text_sha256"), fingerprint_column(text_col, shingle).alias("fp"))
    return _grouped(prints, max_bits).select(F.col("id").alias(id_col), "fp", "component_id", "text_sha256", "group_fp")


def _grouped(prints: DataFrame, max_bits: int) -> DataFrame:
    """The rows of ``prints`` (id, fp and others) with component_id and group_fp of their component."""
    small_batches(prints.sparkSession)
    prints = staged(prints, "prints")
    n_rows = prints.count()
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("size")), "classes")
    stars = staged(components(links(classes.select("fp"), max_bits)), "stars")
    # the smallest id of each component, and from there of each fingerprint in one
    members = staged(stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct()
                     .join(classes.select(F.col("fp").alias("node"), "least_id"), "node"), "members")
    tops = staged(members.groupBy("root").agg(F.min("least_id").alias("top_id"), F.count(F.lit(1)).alias("members")), "tops")
    named = attach(members.select("node", "root"), tops, "root", "members", n_rows).select(F.col("node").alias("fp"), "top_id", "root", F.lit(True).alias("linked"))
    classes = staged(classes.join(named, "fp", "left")
                     .select("fp", "size", F.when(F.col("linked"), F.col("top_id")).otherwise(F.col("least_id")).alias("component_id"),
                             F.coalesce("root", "fp").alias("group_fp")), "classes")
    return attach(prints, classes, "fp", "size", n_rows)
