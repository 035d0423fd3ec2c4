import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from loupe.llm.common import staged
from loupe.llm.packing import CAPACITY
from loupe.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_packing import check as check_bins
from tests.llm.test_simhash import brute_components, plain_fingerprint


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stage = docs.columns, dict(P.STAGES)
    scores = {r.doc_id: r.score for r in score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    clean = staged(stage["toxicity"](spark, docs, sf))
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < THRESHOLD}

    texts = {r.doc_id: r.text for r in clean.collect()}
    single = staged(stage["exact_dedup"](spark, clean, sf))
    least = {}
    for i in sorted(texts):
        least.setdefault(norm(texts[i]), i)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(least.values())

    prints = [(i, plain_fingerprint(texts[i], 3)) for i in sorted(least.values())]
    tops = brute_components(prints, 3)
    near = staged(stage["simhash_near_dedup"](spark, single, sf))
    rows = near.collect()
    assert near.columns == columns and sorted(r.doc_id for r in rows) == sorted(i for (i, _), t in zip(prints, tops) if i == t)

    mixed = staged(stage["mix_sources"](spark, near, sf))
    taken = {d: n // z for d, z, _, _, n in brute_mix([(r.doc_id, r.text, r.source) for r in rows]) if n}
    got = mixed.collect()
    assert mixed.columns == columns and Counter(r.doc_id for r in got) == taken

    packed = stage["best_fit_packing"](spark, mixed, sf).collect()
    check_bins(packed, [(r.doc_id, r.text, r.source) for r in got], CAPACITY)
    run = P.run(spark, sf)
    assert sorted(run.collect()) == sorted(packed)


def test_keep_once_and_odd_rows(spark, sf):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "no id", None, None, None), (None, "no id", None, None, None), (2, None, None, "s", 0), (3, "", "en", None, 0)]
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    out = staged(P.drop_exact_copies(spark, docs, sf))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 2), (True, 0)]
    out = staged(P.drop_near_copies(spark, out, sf))
    assert out.count() == 3
    assert P.pack_bins(spark, P.mix_sources(spark, out, sf), sf).count() >= 0
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_null_and_repeated_ids_with_different_texts(spark, sf):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("river", "copper", "window")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(d, t, "en", "s", 1) for d, t in [(3, texts[0]), (7, texts[0]), (7, texts[1]), (None, texts[1]), (None, texts[2]),
                                              (None, texts[2].replace(" ", "  ")), (None, "alone"), (None, None), (None, "")]]
    docs = staged(spark.createDataFrame(rows, schema).repartition(3))
    out = staged(P.drop_exact_copies(spark, docs, sf))
    want = {(3, texts[0]), (7, texts[1]), (None, texts[2]), (None, "alone"), (None, "")}
    got = [(r.doc_id, norm(r.text)) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    out = P.drop_near_copies(spark, out, sf)
    assert sorted(norm(r.text) for r in out.collect()) == sorted(t for _, t in want)

    # near copies: of one id, of no id, and one id in two groups
    bits = lambda a, b: (plain_fingerprint(a, 3) ^ plain_fingerprint(b, 3)).bit_count()
    upper = [t.upper() for t in texts]
    assert all(bits(a, b) == 0 for a, b in zip(texts, upper)) and min(bits(a, b) for a in texts for b in texts if a != b) > 3
    rows = [(d, t, "en", "s", 1) for d, t in [(7, texts[0]), (7, upper[0]), (7, texts[1]), (9, upper[1]), (None, texts[2]), (None, upper[2])]]
    out = P.drop_near_copies(spark, staged(spark.createDataFrame(rows, schema)), sf)
    got = [(r.doc_id, r.text.lower()) for r in out.collect()]
    assert len(got) == 3 and set(got) == {(7, texts[0]), (7, texts[1]), (None, texts[2])}


def test_stages_keep_maps_and_clashing_columns(spark, sf):
    """Columns of types without an order, and named like those that the stages use inside."""
    rows = [(i, f"text {'a' if i < 6 else i} of document", "en", "s", 3, {"k": i % 2}, "x", 5) for i in range(1, 12)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc map<string,int>, hash string, position int")
    docs = staged(docs.withColumns({"__hash": F.lit(1), "pair": F.lit("p"), "__pair": F.lit("q"), "c0": F.lit(2), "a.b": F.lit(3)}))
    exact = staged(P.drop_exact_copies(spark, docs, sf))
    assert exact.columns == docs.columns and sorted(r.doc_id for r in exact.collect()) == [1, *range(6, 12)]
    mixed = P.mix_sources(spark, staged(P.drop_near_copies(spark, exact, sf)), sf)
    assert mixed.columns == docs.columns and {r["a.b"] for r in mixed.collect()} == {3}
