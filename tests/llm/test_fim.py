import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loupe.llm import fim
from loupe.llm.queries import QUERIES


def plain_rule(doc_id, text, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_plain_rule(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_fill_in_middle"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, pre, mid, out = plain_rule(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, pre, mid, sha(out))
        assert r.restored_sha256 == sha(docs[r.doc_id] or "")


def rows_of_all_kinds():
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "é\nü😀\nx", "<P>", "a<S>b\n", "<", "P>", "x<", "M>\ny", "<\n<P\n>", "<<\n>>\n<S",
             "no line end " * 9000, "\n" * 50000, "long line\n" * 40000 + "é" * 70000, "\r\n\r\n", " \u0085\x0c"]
    texts += ["".join(rng.choice("<PSM>\né x") for _ in range(rng.randrange(30))) for _ in range(400)]
    return [(k if k % 9 else None, t) for k, t in enumerate(texts)] + [(3, "a\nb"), (3, "a\nb"), (3, "b\n")]


def test_nulls_empty_long_markers_repeats_and_clashing_columns(spark):
    rows = rows_of_all_kinds()
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, form int").withColumn("h1", F.lit("x"))
    made = fim.restore(fim.fill_in_middle(docs)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made), key=key)
    want = sorted(((i, *plain_rule(i, t), t or "") for i, t in rows), key=key)
    assert got == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(docs.limit(0))).collect() == []


def test_rate_and_share_of_forms(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    forms = {r.form: r["count"] for r in fim.fill_in_middle(docs, rate=50, spm=20).groupBy("form").count().collect()}
    assert 240 < forms["plain"] < 360 and 30 < forms["spm"] < 100
    want = [plain_rule(i, "a\nb\nc\n", 50, 20)[1] for i in range(600)]
    assert forms == {f: want.count(f) for f in set(want)}


def test_windows_and_parts_carry_their_moves(monkeypatch):
    monkeypatch.setattr(fim, "WINDOW", 7)
    monkeypatch.setattr(fim, "PART", 20)
    rows = [(i, t) for i, t in rows_of_all_kinds() if len(t or "") < 100]
    draws = [[int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for i, _ in rows] for k in range(4)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t or "" for _, t in rows]), "k": pa.array(range(len(rows)))})
    seen = 0
    for part in fim._parts(batch, "text"):
        ks = part.column("k").to_pylist()
        made = fim.transform(part.column("text"), [np.array(d)[ks] for d in draws], 100, 50)
        back = fim.restore_texts(made["output"], made["form"]).to_pylist()
        for j, k in enumerate(ks):
            assert (made["n"][j].as_py(), made["form"][j].as_py(), made["prefix_chars"][j].as_py(), made["middle_chars"][j].as_py(), made["output"][j].as_py()) == plain_rule(*rows[k])
            assert back[j] == (rows[k][1] or "")
        seen += len(ks)
    assert seen == len(rows)
