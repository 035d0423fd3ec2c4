import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loupe.llm.components import components
from loupe.llm.queries import QUERIES
from loupe.llm.simhash import Forest, fingerprint, near_duplicates, walk_links


def plain_fingerprint(text, k):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    """prints: list of (id, unsigned fingerprint) -> component of each row."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i][1] ^ prints[j][1]).count("1") <= bits:
            parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        r = find(i)
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprint_equals_the_plain_rule():
    for text in (None, "", " \t", "One", "One two", "A b\tc\nd  É f a b c", "x " * 9000, "É\xa0é ü k " * 7):
        for k in (3, 5):
            assert fingerprint(text, k) & (2**64 - 1) == plain_fingerprint(text, k)


def test_walk_finds_exactly_the_close_pairs():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(150)]
    keys = sorted(set(base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))) & (2**64 - 1) for b in base]))
    keys = np.array(keys, np.uint64)
    forest = Forest(len(keys))
    walk_links(keys, keys, True, 0, 3, forest, 0)
    root = forest.find(np.arange(len(keys)))
    want = brute_components([(i, int(k)) for i, k in enumerate(keys)], 3)
    assert [int(x) for x in want] == [int(min(np.flatnonzero(root == r))) for r in root]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[k] == 100 for k in range(101, 160)) and got[201] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [(i, plain_fingerprint(t, 3)) for i, t in docs]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints, 3))}
    rows = QUERIES["op1_simhash_near_dedup"](spark, sf).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    long_text = "word" + " lorem ipsum dolor" * 20000
    rows = [(5, None), (3, ""), (9, "  \n"), (None, "only here without id"), (4, long_text), (2, long_text + " x"),
            (7, "same same same"), (7, "same same same"), (8, "same same same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"fp": F.lit("x"), "id": F.lit(1), "component_id": F.lit(None).cast("long")})
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by == {5: {3}, 3: {3}, 9: {3}, None: {None}, 4: {2}, 2: {2}, 7: {7}, 8: {7}}
    assert near_duplicates(docs.limit(0)).collect() == []
