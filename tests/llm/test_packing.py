import random
from collections import defaultdict

from pyspark.sql import functions as F

from loupe.llm import packing
from loupe.llm.packing import best_fit, bitmaps, pack
from loupe.llm.queries import QUERIES


def plain_best_fit(items, capacity):
    """Best fit by looking at every bin: the least residual that holds the item, then the oldest bin."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and not b["s"] & source and not b["c"] & cluster]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": 0, "c": 0})
        out.append((k, capacity - bins[k]["room"]))
        bins[k]["room"] -= size
        bins[k]["s"] |= source
        bins[k]["c"] |= cluster
    return out


def test_best_fit_equals_looking_at_every_bin():
    rng = random.Random(8)
    for capacity in (10, 64):
        for _ in range(30):
            items = [(rng.randrange(1, capacity + 1), rng.choice([0, 1, 2, 4]), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(0, 80))]
            if rng.random() < 0.5:
                items.sort(reverse=True)
            assert best_fit(items, capacity) == plain_best_fit(items, capacity)
    assert bitmaps(["a", None, "b", "a", None, "c"]) == [1, 2, 0, 1, 2, 0]


def check(rows, docs, capacity, size_of=lambda t: len((t or "").split())):
    """All words once, bins within capacity and without overlap, no two documents of a source or cluster in a bin."""
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.bin is not None:
            by_bin[r.bin].append(r)
    expected = defaultdict(list)
    for i, t, s in docs:
        expected[i].append((size_of(t), s, t))
    assert set(by_doc) == set(expected)
    for i, rs in by_doc.items():
        assert sum(r.n_words for r in rs) == sum(z for z, _, _ in expected[i])
        assert len(rs) == sum(max(1, -(-z // capacity)) for z, _, _ in expected[i])
        assert all(r.n_words > 0 and r.start_word == r.piece * capacity for r in rs if r.bin is not None)
    for rs in by_bin.values():
        rs.sort(key=lambda r: r.bin_offset)
        end = 0
        for r in rs:
            assert r.bin_offset == end
            end += r.n_words
        assert end <= capacity
        if len(rs) > 1:
            sources = [expected[r.doc_id][0][1] for r in rs]
            texts = [" ".join((expected[r.doc_id][0][2] or "").split()) for r in rs]
            assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)


def test_query_keeps_all_words_and_all_constraints(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    first = QUERIES["op2_best_fit_packing"](spark, sf).collect()
    check(first, docs, packing.CAPACITY)
    again = pack(spark.read.parquet(f"{sf}/documents.parquet").repartition(5)).collect()
    assert sorted(first) == sorted(again)


def test_hot_source_copies_nulls_long_repeated_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 100)
    rng = random.Random(6)
    docs = [(i, "w" + " w" * rng.randrange(0, 40), "hot" if i % 3 == 0 else f"s{rng.randrange(9)}") for i in range(500)]
    docs += [(1000 + i, "copy of a text", f"s{i % 9}") for i in range(60)] + [(2000, None, None), (2001, "", "s1"), (2002, "long " * 5003, None), (2003, "a b c", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"id": F.lit("x"), "size": F.lit(1), "cluster": F.lit(2), "bin": F.lit(3)})
    check(pack(df, capacity=50).collect(), docs, 50)
    odd = spark.createDataFrame([(None, "no id", "a"), (None, "no id", "b"), (7, "same text", "a"), (7, "same text", "b")], "doc_id long, text string, source string")
    rows = pack(odd, capacity=50).collect()
    assert len(rows) == 4 and len({r.bin for r in rows if r.doc_id == 7}) == 2 and sum(r.n_words for r in rows) == 8
    assert pack(df.limit(0)).collect() == []


def test_rows_without_id_are_spread_over_the_shards(spark, monkeypatch):
    """A third of all rows have neither id nor text: no shard holds much more than its share."""
    monkeypatch.setattr(packing, "SHARD_ROWS", 100)
    largest = []
    real = packing.staged
    monkeypatch.setattr(packing, "staged", lambda df, what: largest.append(real(df, what)) or largest[-1])
    docs = [(None, None, None)] * 1000 + [(i, f"text {i}", f"s{i % 50}") for i in range(2000)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4), capacity=50).collect()
    assert len(rows) == 3000 and sum(r.n_words for r in rows) == 4000
    shard = F.pmod(F.xxhash64(F.coalesce("id", "row"), "size", "cluster", F.lit("shard")), F.lit(30))
    assert largest[0].groupBy(shard).count().agg(F.max("count")).first()[0] < 200
