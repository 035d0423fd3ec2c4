import hashlib
import re

from pyspark.sql import functions as F

from loupe.llm import common
from loupe.llm.exactdedup import exact_dedup


def brute(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for norm, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        kept = False
        for d in ids:
            out.append((d, keep, len(ids), not kept and d == keep, hashlib.sha256(norm.encode()).hexdigest()))
            kept |= d == keep
    return out


def same(df, docs):
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=key)
    assert got == sorted(brute(docs), key=key)


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    long_text = "very long " * 40000
    docs = [(1, None), (2, ""), (None, ""), (3, " "), (4, "\t\n "), (5, "a  b"), (6, "a\nb"), (7, "a b "), (8, long_text), (9, long_text + "x"),
            (10, long_text), (12, "twice"), (12, "twice"), (None, "lonely"), (None, "lonely"), (13, "a b"), (14, "a\x1cb"), (15, "é"), (16, "é")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("x"), "norm": F.lit(1), "hash": F.lit(2), "keep_id": F.lit(3)})
    same(exact_dedup(df), docs)
    assert exact_dedup(df.limit(0)).collect() == []


def test_a_text_of_a_third_of_all_rows_is_sliced_and_merged(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    docs = [(i, "the same text") for i in range(400, 0, -1)] + [(1000 + i, f"text {i}") for i in range(500)] + [(2000 + i, f"text {i % 7}") for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    same(exact_dedup(df), docs)


def test_hot_texts_of_rows_without_id_or_of_one_id_are_sliced_and_keep_one(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    docs = [(None, "no id at all")] * 300 + [(7, "one id")] * 200 + [(9, "one id")] * 50 + [(i, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    same(exact_dedup(df), docs)
    assert exact_dedup(df).where("kept").groupBy("text_sha256").count().where("count > 1").count() == 0
