"""Counts of terms by document: repeated and null ids, and what is shuffled."""
from collections import Counter

from loupe.operators import features as X


def test_counts_with_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT_ROWS", 3)
    docs = [(None, "aa bb aa")] * 5 + [(1, "aa bb")] * 2 + [(2, "cc cc")] * 6 + [(3, None), (4, ""), (5, "dd x dd")]
    want = Counter()
    for i, text in docs:
        for w in ("none" if text is None else text).split():  # X3: a null text is the token None
            if len(w) > 1:
                want[i, w] += 1
    df = spark.createDataFrame(docs, "id long, text string")
    got = [((r["id"], r.term), r.tf) for r in X.term_counts(df, "id", "text").collect()]
    assert len(got) == len(dict(got)) and dict(got) == want


def test_terms_of_a_document_are_counted_without_a_shuffle_of_terms(spark):
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "id long, text string")
    plan = X.term_counts(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    # only the rows of hot ids are spread by term: before, the rows of all ids
    assert sum("Exchange hashpartitioning" in x and "term" in x for x in plan.splitlines()) <= 1
    assert any("Exchange hashpartitioning(id" in x and "REPARTITION" in x for x in plan.splitlines())
