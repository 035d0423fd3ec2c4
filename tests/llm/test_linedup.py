import re

import xxhash
from pyspark.sql import functions as F

from loupe.llm import common
from loupe.llm.linedup import line_dedup


def brute(docs, n=3):
    """docs: list of (doc_id, text) -> (doc_id, n_lines, removed, text); repeated rows are one place."""
    def order(i, t):
        h = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        return (i is None, i or 0, h - (1 << 64) if h >> 63 else h)
    first, windows = {}, {}
    for i, t in docs:
        plain = [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ") for x in (t or "").split("\n")]
        for p in range(len(plain) - n + 1):
            key = tuple(plain[p:p + n])
            if any(key):
                place = (*order(i, t), p)
                windows.setdefault((i, t), []).append((key, place, p))
                first[key] = min(first.get(key, place), place)
    out = []
    for i, t in docs:
        lines, gone = (t or "").split("\n"), set()
        for key, place, p in windows.get((i, t), []):
            if place != first[key]:
                gone |= set(range(p, p + n))
        out.append((i, len(lines), sorted(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def check(spark, docs, df):
    key = lambda r: tuple(str(x) for x in r)
    got = [(r.doc_id, r.n_lines, list(r.removed), r.text) for r in line_dedup(df).collect()]
    assert sorted(got, key=key) == sorted(brute(docs), key=key)


def test_planted_passages_and_odd_texts(spark):
    docs = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\ny"), (3, "a  b\n c \nd"), (4, "q\na b\nc\nd\nz"), (5, "a\na\na\na\na"), (6, None), (7, ""), (8, "\n\n\n\n\n"), (9, "\n\nk\n\n\n"),
            (10, "\n\nk\n"), (11, "b\nc\nd\ne\nf"), (12, "same\ntext\nhere"), (12, "same\ntext\nhere"), (None, "no\nid\nhere"), (None, "no\nid\nhere"), (13, "no\nid\nhere"),
            (14, "l1\r\nl2\r\nl3\r"), (15, "l1\nl2\nl3"), (16, "\n".join(f"line {i % 5000}" for i in range(20000))), (17, "a\x0bb\nc\nd"), (18, "short\ntext")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({"id": F.lit("x"), "key": F.lit(1), "lines": F.lit(2), "n_lines": F.lit(3), "removed": F.lit(4)})
    check(spark, docs, df)
    assert line_dedup(df.limit(0)).collect() == []


def test_a_passage_of_a_third_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    docs = [(i, f"head {i}\n" + ("common 1\ncommon 2\ncommon 3\ncommon 4\n" if i % 3 == 0 else f"own {i}\n\n") + f"tail {i}") for i in range(300)]
    check(spark, docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
