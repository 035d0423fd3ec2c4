"""N-gram Jaccard join: size-aware, with a light and a heavy side.

Texts are sets of word shingles (64-bit hashes); equal sets are one class.  A boundary size parts them:

* light pairs (both sets at most the boundary): every set lists its subsets of the sizes c that a
  linked pair must share.  Two sets with a common subset of size c are linked if c is enough for their
  sizes, so in each group it is enough to link all to its smallest set, which a grouped minimum finds;
* heavy pairs (one set above it): inverted lists.  A linked pair shares a token among the first
  n - ceil(t n) + 1 of each set in a common order (rare ones first), so only those are listed.  The first
  token it shares leaves the items that must be shared behind it in both sets, so most lists of two sets
  that meet by chance go by the places of their token alone.  Lists are scanned in blocks of bounded size: pairs whose parity bitmaps differ in more bits than a linked
  pair may are dropped, the others are thinned to a forest in each block, and its edges are compared
  exactly.  A block with a failed edge offers the pairs that the failure left apart, until none is left.

The boundary is where the subsets of all smaller sets plus the lists of all larger ones cost least.
No step emits all pairs of a group, and nothing of the size of the corpus goes to the driver: it sees a
sketch of shingle counts of fixed size (for the order only), fixed bit sets that thin out shuffles, and
counts by size of the light sets.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations, count
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.llm.common import attach, small_batches, staged
from loupe.llm.components import components
from loupe.llm.simhash import Forest, _spans

#: Counters of the sketch that orders shingles from rare to frequent, and bits of a thinning bit set.
SKETCH_BITS, FILTER_BITS = 18, 22
#: Largest set whose subsets are ever listed (7,140 at 90 %).
LIGHT_MOST = 36
#: Members of an inverted list that are compared in one block; rows and items of a group of lists (a
#: fine bitmap takes 2 to 4 bytes an item); pairs at a time.
BLOCK, GROUP_ROWS, GROUP_ITEMS, PAIRS = 2048, 1 << 15, 1 << 22, 1 << 18
#: Parity bitmaps: tables of a fine one, and the widest table.
TABLES, WIDEST = 4, 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_sets(texts: list[str | None], shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased, words split at white space); a
    text with fewer words has one, of the whole sequence, one without words none."""
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    rows = []
    for text in texts:
        words = (text or "").encode().lower().split()
        rows.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
    base = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
    for row in rows:
        wide = min(shingle, len(row))
        n = len(row) - wide + 1 if wide else 0
        word, out = base[row] if wide else None, np.full(n, wide, np.uint64)
        for k in range(wide):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + word[k:k + n])
        yield np.unique(out)


def _digest(items: np.ndarray) -> tuple[str, int]:
    """Names of a set: 128 bits, and 64 of them (candidates may mix sets that share these)."""
    d = hashlib.md5(items.tobytes()).digest()
    return d.hex(), int.from_bytes(d[:8], "little", signed=True)


class Rule:
    """Which set sizes and intersections link: 100 * shared >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def share(self, s, t):
        """Least intersection of linked sets of s and t items."""
        return -(-self.percent * (s + t) // (100 + self.percent))

    def least(self, s):
        """Least size of a partner of s items, and least intersection with any."""
        return -(-self.percent * s // 100)

    def fits(self, s, t):
        return 100 * np.minimum(s, t) >= self.percent * np.maximum(s, t)

    def prefix(self, s):
        return s - self.least(s) + 1

    def reach(self, s, t):
        """Last place (from 0) in a set of s items of the first item that it shares with a linked set of t."""
        return s - self.share(s, t)

    def subset_sizes(self, s: int, most: int) -> list[int]:
        """The intersections c that light partners of a set of s items need."""
        return sorted({int(self.share(s, t)) for t in range(int(self.least(s)), most + 1) if self.least(t) <= s})


# ---------------------------------------------------------------- parity bitmaps

def _parity(items: np.ndarray, width: int, tables: int) -> bytes:
    out = [np.packbits((np.bincount((items >> np.uint64(16 * t)).astype(np.int64) & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()
           for t in range(tables)]
    return b"".join(out)


def _width(n: int, per_item: float, least: int = 256) -> int:
    """A power of two, about ``per_item`` bits an item."""
    return min(WIDEST, max(least, 1 << max(0, ceil(n * per_item) - 1).bit_length()))


def coarse(items: np.ndarray) -> bytes:
    """Enough to part unrelated sets."""
    return _parity(items, _width(len(items), 0.5), 1)


def fine(items: np.ndarray) -> bytes:
    """Enough to tell almost all pairs just short of a link from linked ones."""
    return _parity(items, _width(len(items), 4), TABLES)


class Bitmaps:
    """The bitmaps of some rows, comparable at any width up to their own (a table folds to half its
    width by xor of its halves)."""

    def __init__(self, maps: list[bytes], tables: int):
        self.tables = tables
        size = np.array([len(m) for m in maps])
        self.width = size * 8 // tables
        self.slot = np.zeros(len(maps), np.int64)
        self.at: dict[int, np.ndarray] = {}
        widths = sorted(set(self.width.tolist()), reverse=True)
        rows: dict[int, list] = {}
        for w in widths:
            mine = np.flatnonzero(self.width == w)
            rows[w] = [(mine, np.frombuffer(b"".join(maps[i] for i in mine), "<u8").reshape(len(mine), tables, -1))]
        self.place: dict[int, np.ndarray] = {}
        for k, w in enumerate(widths):
            parts = list(rows[w])
            if k and widths[k - 1] == 2 * w:  # partners are within a factor of two
                mine, wide = rows[2 * w][0]
                half = wide.shape[2] // 2
                parts.append((mine, wide[:, :, :half] ^ wide[:, :, half:]))
            place = np.full(len(maps), -1, np.int64)
            place[np.concatenate([p[0] for p in parts])] = np.arange(sum(len(p[0]) for p in parts))
            self.at[w], self.place[w] = np.concatenate([p[1] for p in parts]), place

    def near(self, a: np.ndarray, b: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Which pairs differ in no more than the allowed bits in every table."""
        out = np.zeros(len(a), bool)
        width = np.minimum(self.width[a], self.width[b])
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            x, y = self.place[int(w)][a[mine]], self.place[int(w)][b[mine]]
            mine, x, y = (z[(x >= 0) & (y >= 0)] for z in (mine, x, y))  # widths further apart never fit
            bits = self.at[int(w)]
            step = max(1, (1 << 21) // bits.shape[2])
            for t in range(self.tables):
                keep = np.concatenate([np.bitwise_count(bits[x[k:k + step], t] ^ bits[y[k:k + step], t]).sum(1, dtype=np.int64) for k in range(0, len(x), step)] or [np.zeros(0, np.int64)])
                keep = keep <= allowed[mine]
                mine, x, y = mine[keep], x[keep], y[keep]
            out[mine] = True
        return out


def list_pairs(first: np.ndarray, part: np.ndarray, n: np.ndarray, bits: Bitmaps, rule: Rule, heavy_from: int,
               place: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list that may be linked, some at a time.  ``first``: end of each row's list
    (rows of a list stand together); ``part``: rows with the same non-negative part are not compared
    (another block does that); a pair has one set of ``heavy_from`` items at least.  With ``place`` (of the
    list's token in each set), only pairs whose first shared token may be this one."""
    rest = first - np.arange(len(first)) - 1  # rows after it in its list
    total = np.cumsum(rest)
    lo = 0
    while lo < len(rest):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
        a = np.repeat(np.arange(lo, hi), rest[lo:hi])
        b = _spans(np.arange(lo, hi) + 1, rest[lo:hi])
        keep = rule.fits(n[a], n[b]) & (np.maximum(n[a], n[b]) >= heavy_from) & ((part[a] < 0) | (part[a] != part[b]))
        a, b = a[keep], b[keep]
        if place is not None:
            keep = (place[a] <= rule.reach(n[a], n[b])) & (place[b] <= rule.reach(n[b], n[a]))
            a, b = a[keep], b[keep]
        near = bits.near(a, b, n[a] + n[b] - 2 * rule.share(n[a], n[b]))
        yield a[near], b[near]
        lo = hi


def forest_edges(a: np.ndarray, b: np.ndarray, forest: Forest) -> np.ndarray:
    """Places of pairs that connect what was apart, at most two for each tree that they join."""
    out = []
    left = np.arange(len(a))
    while len(left):
        ra, rb = forest.find(a[left]), forest.find(b[left])
        apart = ra != rb
        left, ra = left[apart], ra[apart]
        if not len(left):
            break
        pick = left[np.unique(ra, return_index=True)[1]]
        out.append(pick)
        forest.add(a[pick], b[pick])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


# ---------------------------------------------------------------- passes over the texts

def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        yield batch, list(shingle_sets(batch.column("text").to_pylist(), shingle))


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """One row a document: id, n, digest, short, coarse, the items of a light set; and a row a task
    (without digest) with its counts for the sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, kind = np.zeros(1 << SKETCH_BITS, np.int64), None
        for batch, sets in _sets(batches, shingle):
            if not sets:
                continue
            kind = batch.column("id").type
            names = [_digest(s) for s in sets]
            counters += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counters))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "n": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array([d for d, _ in names], pa.string()),
                "short": pa.array([k for _, k in names], pa.int64()), "coarse": pa.array([coarse(s) for s in sets], pa.binary()),
                "items": pa.array([s.view(np.int64) if len(s) <= LIGHT_MOST else None for s in sets], pa.list_(pa.int64())),
                "bucket": pa.nulls(len(sets), pa.list_(pa.int32())), "seen": pa.nulls(len(sets), pa.list_(pa.int64()))})
        if kind is not None:
            some = np.flatnonzero(counters)
            yield pa.RecordBatch.from_pydict({
                "id": pa.nulls(1, kind), "n": pa.nulls(1, pa.int64()), "digest": pa.nulls(1, pa.string()), "short": pa.nulls(1, pa.int64()),
                "coarse": pa.nulls(1, pa.binary()), "items": pa.nulls(1, pa.list_(pa.int64())),
                "bucket": pa.array([some.astype(np.int32)], pa.list_(pa.int32())), "seen": pa.array([counters[some]], pa.list_(pa.int64()))})

    rest = T.StructType.fromDDL("n long, digest string, short long, coarse binary, items array<long>, bucket array<int>, seen array<long>")
    return docs.mapInArrow(run, T.StructType([T.StructField("id", docs.schema["id"].dataType)] + rest.fields))


def _order(prints: DataFrame) -> np.ndarray:
    """Counts of shingles by the upper bits of their hash; 2**SKETCH_BITS of them, whatever the input."""
    found = (prints.where("bucket is not null").select(F.explode(F.arrays_zip("bucket", "seen")).alias("x"))
             .groupBy(F.col("x.bucket").alias("bucket")).agg(F.sum("x.seen").alias("seen")).toArrow())
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[found["bucket"].to_numpy()] = found["seen"].to_numpy()
    return out


def first_items(items: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The k first items by (count of the sketch, hash); ``items`` ascend."""
    n = order[(items >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    bound = np.partition(n, k - 1)[k - 1]
    take = n < bound
    take[np.flatnonzero(n == bound)[:k - int(take.sum())]] = True
    return items[take]


def places(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place of each of the first items of a set in the common order; ``tokens`` ascend."""
    out = np.empty(len(tokens), np.int64)
    out[np.argsort(order[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")] = np.arange(len(tokens))
    return out


def _postings(docs: DataFrame, shingle: int, order: np.ndarray, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, shingle):
            sets = [s for s in sets if len(s)]
            if not sets:
                continue
            tokens = [first_items(s, order, int(rule.prefix(len(s)))) for s in sets]
            many = [len(t) for t in tokens]
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(np.concatenate(tokens).view(np.int64)), "short": pa.array(np.repeat(np.array([_digest(s)[1] for s in sets], np.int64), many)),
                "n": pa.array(np.repeat(np.array([len(s) for s in sets], np.int64), many)), "place": pa.array(np.concatenate([places(t, order) for t in tokens]))})

    return docs.select("text").mapInArrow(run, "token long, short long, n long, place long")


def _bit_set(rows: DataFrame, key: str) -> np.ndarray:
    """2**FILTER_BITS bits (of fixed size) in which all values of ``key`` are marked, and others may be.
    The driver gets them in words of 64."""
    at = F.expr(f"{key} & {(1 << FILTER_BITS) - 1}")
    words = rows.select(at.alias("at")).groupBy(F.expr("cast(shiftright(at, 6) as int)").alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _in_bit_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & ((1 << FILTER_BITS) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _thinned(rows: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """``rows`` without most of those whose long ``key`` is not in the bit set (a join follows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_bit_set(bits, batch.column(key).to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def _full_sets(docs: DataFrame, shingle: int, needed: DataFrame) -> DataFrame:
    """(short, digest, n, fine, items) of the sets whose ``short`` is in ``needed``, one row each."""
    bits = _bit_set(needed, "short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, shingle):
            named = {d: (k, s) for s in sets if len(s) for d, k in [_digest(s)] if _in_bit_set(bits, np.array([k]))[0]}
            yield pa.RecordBatch.from_pydict({
                "short": pa.array([k for k, _ in named.values()], pa.int64()), "digest": pa.array(list(named), pa.string()), "n": pa.array([len(s) for _, s in named.values()], pa.int64()),
                "fine": pa.array([fine(s) for _, s in named.values()], pa.binary()), "items": pa.array([s.view(np.int64) for _, s in named.values()], pa.list_(pa.int64()))})

    found = docs.select("text").mapInArrow(run, "short long, digest string, n long, fine binary, items array<long>")
    return found.join(needed, "short", "left_semi").groupBy("digest").agg(*[F.first(c).alias(c) for c in ("short", "n", "fine", "items")])


# ---------------------------------------------------------------- light pairs

@cache
def _removals(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(comb(n, k), k)


def subsets(items: np.ndarray, size: int) -> np.ndarray:
    """128-bit names of all subsets of ``size`` items, as two longs each."""
    out = _removals(len(items), len(items) - size)
    keys = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        h = _mix(items.view(np.uint64) ^ np.uint64(salt))
        keys.append((h.sum(dtype=np.uint64) - h[out].sum(axis=1, dtype=np.uint64)).view(np.int64))
    return np.stack(keys, 1)


def boundary(sets: dict[int, int], scans: dict[int, int], rule: Rule) -> int:
    """The size up to which listing subsets (``sets``: sets of each size) plus scanning the lists of
    larger ones (``scans``: members met by sets of each size) costs least."""
    def cost(most: int) -> int:
        listed = sum(n * sum(comb(s, c) for c in rule.subset_sizes(s, most)) for s, n in sets.items() if s <= most)
        return listed + sum(n for s, n in scans.items() if s > most)
    return min(range(LIGHT_MOST + 1), key=cost)


def _light_links(light: DataFrame, most: int, rule: Rule, n_rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, items in zip(batch.column("digest").to_pylist(), batch.column("items")):
                items = items.values.to_numpy()
                for c in rule.subset_sizes(len(items), most):
                    keys = subsets(items, c)
                    yield pa.RecordBatch.from_pydict({
                        "c": pa.array([c] * len(keys), pa.int32()), "k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1]),
                        "n": pa.array([len(items)] * len(keys), pa.int64()), "digest": pa.array([digest] * len(keys), pa.string())})

    keys = light.select("digest", "items").mapInArrow(run, "c int, k1 long, k2 long, n long, digest string")
    keys = staged(keys.select(F.struct("c", "k1", "k2").alias("key"), "n", "digest"), "subsets")
    groups = staged(keys.groupBy("key").agg(F.min(F.struct("n", "digest")).alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1"), "subset-groups")
    enough = F.expr(f"{100 + rule.percent} * key.c >= {rule.percent} * (n + top.n)")
    met = attach(keys, groups, "key", "size", max(n_rows, 1)).where(enough & (F.col("digest") != F.col("top.digest")))
    return met.select(F.col("digest").alias("u"), F.col("top.digest").alias("v")).distinct()


# ---------------------------------------------------------------- heavy pairs

LISTS = ["token", "i", "j"]


def _blocks(members: DataFrame) -> DataFrame:
    """Members (token, short, place if any, size of the list) dealt to blocks of their list: (token, i, j), and
    part, the member's side in a block of two (-1 where a block is compared with itself)."""
    place = [c for c in members.columns if c == "place"]
    dealt = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("short", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("token", "short", *place, "own", other)
    return dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "short", *place,
                        F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("part"))


def _grouped(rows: DataFrame, members: DataFrame) -> DataFrame:
    """With grp, which gathers whole blocks into groups of bounded size on average."""
    n_rows, n_items = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rows.withColumn("grp", F.pmod(F.xxhash64(*LISTS), F.lit(n_rows // GROUP_ROWS + n_items // GROUP_ITEMS + 1)).cast("int"))


def _sized(members: DataFrame, rule: Rule, heavy_from: int) -> DataFrame:
    """Members (token, short, n) with the size of their list; lists without a pair to compare go, as do
    lists of two sets whose sizes do not fit, or with column place, whose first shared token this cannot be
    (most of those that meet by chance), and longer ones in which no set has the token early enough for a
    larger one."""
    n_rows = members.count()
    row = F.struct("n", *(["place"] if "place" in members.columns else [F.lit(0).cast("long").alias("place")]))
    need = lambda s, t: f"cast(ceil({rule.percent} * ({s} + {t}) / {100 + rule.percent}) as long)"
    lists = members.select("token", row.alias("row"), F.expr(f"row.place <= row.n - {need('row.n', 'row.n')}").alias("early")).groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min("row").alias("a"), F.max("row").alias("z"), F.max("early").alias("early"))
    two = f"size = 2 and 100 * a.n >= {rule.percent} * z.n and a.place <= a.n - {need('a.n', 'z.n')} and z.place <= z.n - {need('a.n', 'z.n')}"
    lists = staged(lists.where(f"z.n >= {heavy_from} and (size > 2 and early or {two})").select("token", "size"), "lists")
    return attach(members, lists, "token", "size", n_rows)


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows list by list, and the end of each row's list."""
    pdf = pdf.sort_values(LISTS, kind="stable", ignore_index=True)
    keys = pdf[LISTS].to_numpy()
    new = np.flatnonzero(np.append((keys[1:] != keys[:-1]).any(1), True)) + 1
    return pdf, np.repeat(new, np.diff(new, prepend=0))


def _candidates(members: DataFrame, classes: DataFrame, rule: Rule, heavy_from: int) -> DataFrame:
    """Members of lists that have a partner there, as far as coarse bitmaps tell."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, ends = _sorted(pdf)
        met = np.zeros(len(pdf), bool)
        for a, b in list_pairs(ends, pdf["part"].to_numpy(), pdf["n"].to_numpy(), Bitmaps(pdf["coarse"].tolist(), 1), rule, heavy_from, pdf["place"].to_numpy()):
            met[a] = met[b] = True
        return pdf.loc[met, ["token", "short", "n"]]

    rows = _blocks(_sized(members, rule, heavy_from)).join(classes.select("short", "n", "coarse"), "short")
    return _grouped(rows, members).groupBy("grp").applyInPandas(run, "token long, short long, n long").distinct()


def _one_of_equal_lists(members: DataFrame) -> DataFrame:
    """Of lists with the same members, only one: near copies share most of their tokens."""
    sums = [F.sum(F.xxhash64("short", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    lists = members.groupBy("token").agg(F.count(F.lit(1)).alias("size"), *sums)
    kept = staged(lists.groupBy("size", "s1", "s2").agg(F.min("token").alias("token")).select("token", "size"), "lists")
    return attach(members, kept, "token", "size", members.count()).drop("size")


def _verified(edges: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Edges (u, v) with ``linked``: the exact comparison of both whole sets."""
    side = lambda name: sets.select(F.col("digest").alias(name), F.col("n").alias(f"n_{name}"), F.col("items").alias(f"i_{name}"))
    shared = F.size(F.array_intersect("i_u", "i_v")).cast("long")
    return edges.join(side("u"), "u").join(side("v"), "v").select("u", "v", (100 * shared >= rule.percent * (F.col("n_u") + F.col("n_v") - shared)).alias("linked"))


def _heavy_links(members: DataFrame, sets: DataFrame, rule: Rule, heavy_from: int) -> list[DataFrame]:
    """Links (u, v) that connect all linked heavy pairs of ``members`` (token, short, n)."""
    rows = _grouped(_blocks(_sized(members, rule, heavy_from)).join(sets.select("short", "digest", "n", "fine"), "short"), members)
    spark = members.sparkSession
    tried = spark.createDataFrame([], "grp int, token long, i int, j int, u string, v string, linked boolean")
    links, turn = [], 0
    while True:
        turn += 1
        first, most = turn == 1, 8 ** turn

        def offer(own: pd.DataFrame, tried: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame(columns=["grp", *LISTS, "u", "v", "more"], dtype=object)
            if not len(own):
                return none
            own, ends = _sorted(own)
            name, forest = own["digest"].to_numpy(), Forest(len(own))
            done = np.zeros(0, np.int64)
            if len(tried):
                place = own.reset_index().rename(columns={"index": "at"})[[*LISTS, "digest", "at"]]
                known = tried.merge(place.rename(columns={"digest": "u", "at": "a"}), on=[*LISTS, "u"]).merge(place.rename(columns={"digest": "v", "at": "b"}), on=[*LISTS, "v"])
                a, b = known["a"].to_numpy(), known["b"].to_numpy()
                done = np.sort(np.minimum(a, b) * len(own) + np.maximum(a, b))
                linked = known["linked"].to_numpy(bool)
                forest.add(a[linked], b[linked])
            found, more = [], False
            for a, b in list_pairs(ends, own["part"].to_numpy(), own["n"].to_numpy(), Bitmaps(own["fine"].tolist(), TABLES), rule, heavy_from):
                fresh = ~np.isin(a * len(own) + b, done, kind="sort") & (name[a] != name[b])
                a, b = a[fresh], b[fresh]
                if first:
                    pick = forest_edges(a, b, forest)
                else:
                    pick = np.flatnonzero(forest.find(a) != forest.find(b))
                    room = most * len(own) - sum(len(x) for x, _ in found)
                    pick, more = pick[:max(0, room)], more or len(pick) > room
                found.append((a[pick], b[pick]))
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (done, done)
            if not len(a):
                return none
            out = own.loc[a, ["grp", *LISTS]].reset_index(drop=True)
            out["u"], out["v"], out["more"] = np.minimum(name[a], name[b]), np.maximum(name[a], name[b]), more
            return out

        edges = staged(rows.groupBy("grp").cogroup(tried.withColumnRenamed("grp", "to").groupBy("to"))
                       .applyInPandas(offer, "grp int, token long, i int, j int, u string, v string, more boolean"), "edges")
        verdicts = staged(_verified(edges.select("u", "v").distinct(), sets, rule), "verdicts")
        links.append(verdicts.where("linked").select("u", "v"))
        now = staged(edges.join(verdicts, ["u", "v"]), "tried")
        # a block goes on if an edge failed there or pairs wait
        open_ = staged(now.where("not linked or more").select(*LISTS).distinct(), "open")
        if open_.isEmpty():
            return links
        rows = rows.join(open_, LISTS, "left_semi")
        tried = tried.unionByName(now.drop("more")).join(open_, LISTS, "left_semi")


# ---------------------------------------------------------------- the operator

def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (distinct word shingles), component_id (smallest id of
    the documents reachable by links, itself included).

    Two documents are linked when 100 * shared shingles >= ``percent`` * all shingles of both.  A text
    with fewer words than a shingle has one shingle, its whole sequence; one without words (null, empty)
    is linked with nothing.  Rows without id are members but never name a component; one of only such
    rows has a null component_id.  Repeated rows are repeated in the result, an empty table gives an
    empty one, other columns are not read.  Whole texts are read (three times), whatever their length."""
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100")
    small_batches(docs.sparkSession)
    rule = Rule(percent)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = staged(_prints(docs, shingle), "prints")
    rows = prints.where("digest is not null").select("id", "n", "digest")
    n_rows = rows.count()
    classes = staged(prints.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("least_id"), F.count(F.lit(1)).alias("size"), *[F.first(c).alias(c) for c in ("n", "short", "coarse", "items")]), "classes")

    postings = staged(_postings(docs, shingle, _order(prints), rule), "postings")
    light = classes.where(F.col("n") <= LIGHT_MOST)
    sets = {r[0]: r[1] for r in light.groupBy("n").count().collect()}  # at most LIGHT_MOST rows
    short = postings.where(F.col("n") <= LIGHT_MOST).groupBy("token", "n").agg(F.count(F.lit(1)).alias("own"))
    scans = {r[0]: r[1] for r in short.join(short.groupBy("token").agg(F.sum("own").alias("all")), "token").groupBy("n").agg(F.sum(F.col("own") * F.col("all"))).collect()}
    most = boundary(sets, scans, rule)

    links = [_light_links(light.where(F.col("n") <= most), most, rule, n_rows)]
    listed = postings.where(F.col("n") >= int(rule.least(most + 1)))
    lists = staged(listed.groupBy("token").agg(F.min("short").alias("lo"), F.max("short").alias("hi")).where("lo <> hi").select("token"), "lists")
    members = staged(_thinned(listed, "token", _bit_set(lists, "token")).distinct(), "members")
    members = staged(members.join(lists, "token", "left_semi"), "members")
    members = staged(_candidates(members, classes, rule, most + 1), "candidates")
    members = staged(_one_of_equal_lists(members), "candidates")
    full = staged(_full_sets(docs, shingle, members.select("short").distinct()), "sets")
    links += _heavy_links(members, full, rule, most + 1)

    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    stars = staged(components(staged(edges, "links")), "stars")
    named = stars.unionByName(stars.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("node", "digest")
    named = staged(named.join(classes.select("digest", "least_id"), "digest"), "named")
    tops = staged(named.groupBy("root").agg(F.min("least_id").alias("top_id"), F.count(F.lit(1)).alias("members")), "tops")
    named = attach(named.select("digest", "root"), tops, "root", "members", n_rows).select("digest", "top_id", F.lit(True).alias("tied"))
    classes = staged(classes.select("digest", "size", "least_id").join(named, "digest", "left")
                     .select("digest", "size", F.when(F.col("tied"), F.col("top_id")).otherwise(F.col("least_id")).alias("component_id")), "classes")
    out = attach(rows.where("n > 0"), classes, "digest", "size", n_rows).select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
