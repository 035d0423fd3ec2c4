import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.llm import jaccard as J
from loupe.llm.queries import QUERIES
from loupe.llm.simhash import Forest


def plain_set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k=3, percent=90):
    """rows: (id, text) -> [(id, n, component)]"""
    sets = [plain_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_size = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(by_size):
        for j in by_size[x + 1:]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [(name, len(sets[i]), least.get(find(i))) for i, (name, _) in enumerate(rows)]


def key(r):
    return tuple((x is not None, x) for x in r)


def found(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()], key=key)


def near_copies(seed, groups=25, most=120):
    """Texts of all sizes with copies that differ in few words, so that many pairs stand near the threshold."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(rng.choice([2, 3, 8, 11, 12, 21, 30, 31, 40, 60, most]))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randrange(0, 2)] = [f"z{rng.randrange(10**6)}"] * rng.randrange(0, 2)
            texts.append(" ".join(copy) if rng.random() < 0.9 else "  ".join(copy).upper() + "\n")
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 1, 80), (3, 2, 60)])
def test_equals_brute_force(spark, seed, k, percent):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = found(J.jaccard_components(docs, shingle=k, percent=percent))
    assert got == sorted(brute(rows, k, percent), key=key)
    assert len({c for _, _, c in got}) < len(rows) - 20


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op13_jaccard_join"](spark, sf)) == sorted(brute(rows), key=key)


def test_only_lists_and_tiny_blocks(spark, monkeypatch):
    """All pairs by inverted lists, in blocks of three and many groups, with bitmaps that let much pass."""
    for name, value in {"LIGHT_MOST": 0, "BLOCK": 3, "GROUP_ROWS": 20, "PAIRS": 5, "WIDEST": 64}.items():
        monkeypatch.setattr(J, name, value)
    monkeypatch.setattr(J, "_width", lambda n, per_item, least=64: 64)
    rows = near_copies(4, groups=12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(J.jaccard_components(docs, shingle=3, percent=90)) == sorted(brute(rows), key=key)


def test_only_subsets(spark, monkeypatch):
    monkeypatch.setattr(J, "boundary", lambda sets, scans, rule: J.LIGHT_MOST)
    rows = [(k, t) for k, t in near_copies(5, groups=40, most=34) if len(t.split()) < 36]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(J.jaccard_components(docs, shingle=3, percent=90)) == sorted(brute(rows), key=key)


def test_nulls_empty_long_ties_repeats_and_clashing_columns(spark):
    long_text = " ".join(f"w{i * 7919 % 30011}" for i in range(30000))
    rows = [(5, None), (6, ""), (None, " \t"), (9, "one"), (8, "ONE"), (7, "one two"), (4, "one two"), (4, "one two"), (3, long_text), (2, long_text + " tail"),
            (None, "no id here at all"), (None, "no id here at all"), (12, "no id here at all"), (None, "another without id"), (1, "a b a b a b a b"), (11, "b a b a b a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "digest": F.lit(1), "id": F.lit(2), "items": F.lit(None).cast("int")})
    assert found(J.jaccard_components(docs, shingle=3, percent=90)) == sorted(brute(rows), key=key)
    assert J.jaccard_components(docs.limit(0)).collect() == []
    assert found(J.jaccard_components(docs.where("doc_id = 5 or doc_id = 9"), shingle=3)) == [(5, 0, 5), (9, 1, 9)]


def test_many_rows_without_id_and_a_hot_group(spark):
    base = [f"w{i}" for i in range(60)]
    hot = [(None if k % 3 else k, " ".join(base[:-1] + [f"x{k % 40}"])) for k in range(300)]
    rows = hot + [(1000 + k, " ".join(f"y{k}a{i}" for i in range(50))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(J.jaccard_components(docs, shingle=3, percent=90)) == sorted(brute(rows), key=key)


def test_rule_prefix_and_subsets_by_counting():
    rule = J.Rule(90)
    for s, t in itertools.product(range(1, 70), repeat=2):
        need = min((i for i in range(min(s, t) + 1) if 100 * i >= 90 * (s + t - i)), default=None)
        assert (need is not None) == bool(rule.fits(s, t)) and (need is None or (need == rule.share(s, t) and need >= rule.least(max(s, t))))
    items = np.sort(np.array([3, 99, 10**15, 2**63 + 5, 7], np.uint64))
    names = {tuple(x) for size in range(1, 6) for x in J.subsets(items, size).tolist()}
    assert len(names) == 31


def test_bitmaps_never_drop_a_near_pair():
    rng = np.random.default_rng(2)
    sets = []
    for n in (20, 63, 64, 65, 130, 300, 700, 5000, 20000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[n // 20:], rng.integers(0, 2**63, n // 30).astype(np.uint64)])), np.unique(rng.integers(0, 2**63, n).astype(np.uint64))]
    a, b = np.array(list(itertools.combinations(range(len(sets)), 2))).T
    rule, size = J.Rule(90), np.array([len(s) for s in sets])
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    fit = rule.fits(size[a], size[b])
    a, b, apart = a[fit], b[fit], apart[fit]
    allowed = size[a] + size[b] - 2 * rule.share(size[a], size[b])
    for make, tables in ((J.coarse, 1), (J.fine, J.TABLES)):
        near = J.Bitmaps([make(s) for s in sets], tables).near(a, b, allowed)
        assert near[apart <= allowed].all()
        assert not near[apart > 4 * allowed + 8].any()


def test_forest_edges_join_all():
    a, b = np.array([0, 1, 2, 0, 4, 5]), np.array([1, 2, 3, 3, 5, 6])
    forest = Forest(8)
    pick = J.forest_edges(a, b, forest)
    again = Forest(8)
    again.add(a[pick], b[pick])
    assert [x.tolist() for x in (forest.find(np.arange(8)) == 0, again.find(np.arange(8)) == 0)] == [[True] * 4 + [False] * 4] * 2


def members_of(spark, rows, rule, k=3):
    """The members of all lists of two sets or more, as the operator makes them."""
    docs = spark.createDataFrame(rows, "id long, text string")
    prints = J.staged(J._prints(docs, k), "prints")
    members = J._postings(docs, k, J._order(prints), rule).distinct()
    return J.staged(members.join(members.groupBy("token").count().where("count > 1").select("token"), "token", "left_semi"), "members")


def test_lists_go_whose_token_stands_too_late_to_be_the_first_shared(spark):
    rng = random.Random(6)
    common = [f"c{k}a{i}" for k in range(60) for i in range(3)]  # 60 shingles, each shared by two texts by chance
    rows = [(k, " ".join([f"u{k}a{i}" for i in range(100)] + common[3 * (k // 2):3 * (k // 2) + 3])) for k in range(120)]
    rows += [(1000 + k, t) for k, t in near_copies(7, groups=8) if len(t.split()) > 20]
    rng.shuffle(rows)
    rule = J.Rule(90)
    members = members_of(spark, rows, rule)
    every = {(r.token, r.short) for r in members.collect()}
    kept = {(r.token, r.short) for r in J._sized(members, rule, 1).collect()}
    assert kept < every
    sized = {r.short: r.n for r in members.collect()}
    place = {(r.token, r.short): r.place for r in members.collect()}
    lists = {}
    for token, short in every:
        lists.setdefault(token, []).append(short)
    linked = {s: set(next(J.shingle_sets([t], 3)).tolist()) for _, t in rows for s in [J._digest(next(J.shingle_sets([t], 3)))[1]]}
    for token, some in lists.items():
        fits = [(a, b) for a, b in itertools.combinations(some, 2) if all(place[token, x] <= rule.reach(sized[x], sized[y]) for x, y in ((a, b), (b, a)))]
        assert not fits or all((token, x) in kept for x in some)
        assert len(some) > 2 or fits or not kept & {(token, x) for x in some}
    # each linked pair has a list that stays and that holds both early enough
    for a, b in itertools.combinations(sorted(linked), 2):
        shared = len(linked[a] & linked[b])
        if 100 * shared >= 90 * (len(linked[a]) + len(linked[b]) - shared):
            assert any({(t, a), (t, b)} <= kept and place[t, a] <= rule.reach(sized[a], sized[b]) and place[t, b] <= rule.reach(sized[b], sized[a])
                       for t, some in lists.items() if a in some and b in some)
