import base64
import gzip
import hashlib
import heapq
import io
import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loupe.llm import warc
from loupe.llm.queries import QUERIES
from loupe.llm.warc import LoserTree, archive, parse_records, url_key, write_warc


@given(st.lists(st.lists(st.integers(-50, 50), max_size=20), max_size=9))
def test_loser_tree_merges_like_heapq(runs):
    runs = [sorted(r) for r in runs]
    tagged = [[(x, i) for x in r] for i, r in enumerate(runs)]
    assert list(LoserTree(tagged, key=lambda x: x[0])) == list(heapq.merge(*tagged, key=lambda x: x[0]))


def test_url_keys():
    assert url_key("HTTPS://User@WWW.Example.com:443/a/b?q=1#frag") == "com,example,www)/a/b?q=1"
    assert url_key("http://example.com:8080") == "com,example:8080)/"
    assert url_key("") == ")/"


def brute(pages):
    groups, out = {}, []
    for p, _, html in pages:
        groups.setdefault(html or "", []).append(p)
    for p, _, html in pages:
        data = (html or "").encode()
        top = max((x for x in groups[html or ""] if x is not None), default=None)
        response = top is None or p == top
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top))
    return out


def rows(df):
    return [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()]


KEY = lambda r: tuple(str(x) for x in r)


def test_query_equals_brute_force(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(rows(QUERIES["op7_warc_archive"](spark, sf)), key=KEY) == sorted(brute(pages), key=KEY)


ODD = [(1, "http://a.example/x", None), (2, "http://a.example/x", ""), (3, None, "body\r\n\r\nWARC/1.1\r\n\r\nmore"), (4, "http://b.example/\r\nWARC-Type: x", "body\r\n\r\nWARC/1.1\r\n\r\nmore"),
       (None, "http://c.example", "no id"), (None, "http://c.example", "no id"), (5, "http://ü.example/ä", "é" * 300000), (6, "", "é" * 300000),
       (7, "http://a.example/x", "same"), (7, "http://a.example/x", "same"), (None, "u", "same"), (-3, "u", "neg"), (8, "u", "neg\n")]


def test_odd_pages_and_global_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    rng = random.Random(2)
    pages = ODD + [(100 + i, f"http://h{rng.randrange(9)}.example/{rng.randrange(20)}", f"page {i % 40}") for i in range(300)]
    rng.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).withColumns({"digest": F.lit(1), "top": F.lit("x"), "value": F.lit(2), "n": F.lit(3)})
    index = archive(df)
    got = index.collect()
    assert sorted(rows(index), key=KEY) == sorted(brute(pages), key=KEY)
    order = [(r.urlkey, r.date, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.part, r.place))]
    assert order == sorted(order)
    assert archive(df.limit(0)).collect() == []


def test_files_are_plain_warc(spark, tmp_path):
    df = spark.createDataFrame(ODD, "page_id long, url string, html string").coalesce(1)
    write_warc(df, str(tmp_path / "w"))
    seen = 0
    for f in (tmp_path / "w").glob("part-*.gz"):
        data = gzip.decompress(f.read_bytes())
        for start, length, headers, block in parse_records(io.BytesIO(data)):
            assert data[start:start + 10] == b"WARC/1.1\r\n" and data[start + length - 4:start + length] == b"\r\n\r\n"
            assert int(headers["content-length"]) == len(block)
            seen += 1
    assert seen == len(ODD)
