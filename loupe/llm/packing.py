"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A document longer than a bin fills bins of its own and leaves a rest; rests and short documents are
packed, largest first, into the bin with the least room that still holds them (best fit).  A bin
carries a bitmap of the sources and one of the duplicate clusters in it, and takes at most one
document of each; the search goes from the tightest bin that has room on to the next larger one
until a compatible bin is found, and opens a new bin otherwise.

Documents are dealt by hash into shards of about SHARD_ROWS, so every shard holds the same blend of
sources and clusters, however hot one of them is; a shard is packed as one group of narrow rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import staged, word_count
from loupe.llm.exactdedup import normalised

CAPACITY = 2048
SHARD_ROWS = 4096
PIECE = "id long, piece int, start_word long, n_words long, bin long, bin_offset long"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (size up to capacity, source bitmap, cluster bitmap), in the order given."""
    room: list[tuple[int, int]] = []  # (residual, bin), ordered
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        k = bisect_left(room, (size, -1))
        while k < len(room) and (sources[room[k][1]] & source or clusters[room[k][1]] & cluster):
            k += 1
        if k < len(room):
            residual, b = room.pop(k)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        out.append((b, capacity - residual))
        if residual > size:
            insort(room, (residual - size, b))
    return out


def bitmaps(values: list) -> list[int]:
    """A bit for each value that occurs more than once; values that stand alone conflict with nothing."""
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    place = {v: i for i, v in enumerate(v for v, n in counts.items() if n > 1)}
    return [1 << place[v] if v in place else 0 for v in values]


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         cluster_col: str | None = None) -> DataFrame:
    """A row for each piece of each row of ``docs``: id, piece (from 0), start_word, n_words, bin, bin_offset.

    The duplicate cluster is ``cluster_col``, or texts that are equal but for white space.  Null
    sources are one source.  A text without words (null, empty) has one piece of no words and no bin
    (null).  Repeated rows and null ids are packed like other rows; repeated rows are of one cluster, so
    never in one bin.  An empty table gives an empty result; other columns are not read.  The same
    rows give the same bins, however they are partitioned; rows without id are dealt by their place in the
    written table of sizes, so theirs depend on the partitioning."""
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.hex(F.xxhash64(normalised(text_col)))
    rows = staged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                              cluster.alias("cluster"), word_count(text_col).alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    n_shards = max(1, -(-rows.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64(F.coalesce("id", "row"), "size", "cluster", F.lit("shard")), F.lit(n_shards))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["shard"].iloc[0]) << 32
        rows = [(None if none else int(i), s, c, int(z)) for i, none, s, c, z in zip(pdf["id"], pdf["no_id"], pdf["source"], pdf["cluster"], pdf["size"])]
        rows.sort(key=lambda r: (-(r[3] % capacity), r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2] or "", r[3]))
        rests = [r for r in rows if r[3] % capacity]
        source, group = bitmaps([r[1] for r in rests]), bitmaps([r[2] for r in rests])
        placed = best_fit([(r[3] % capacity, s, c) for r, s, c in zip(rests, source, group)], capacity)
        out, bins = [], 1 + max((b for b, _ in placed), default=-1)
        for i, _, _, size in rows:
            for piece in range(size // capacity):
                out.append((i, piece, piece * capacity, capacity, base + bins, 0))
                bins += 1
            if not size:
                out.append((i, 0, 0, 0, None, None))
        for (i, _, _, size), (b, offset) in zip(rests, placed):
            out.append((i, size // capacity, size // capacity * capacity, size % capacity, base + b, offset))
        frame = pd.DataFrame(out, columns=["id", "piece", "start_word", "n_words", "bin", "bin_offset"])
        return frame.assign(**{c: frame[c].astype("Int64") for c in ("id", "bin", "bin_offset")})

    named = rows.select(shard.alias("shard"), F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "source", "cluster", "size")
    return named.groupBy("shard").applyInPandas(fill, PIECE).withColumnRenamed("id", id_col)
