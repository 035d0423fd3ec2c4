import random
import zlib

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loupe.llm import tokenfile
from loupe.llm.queries import QUERIES
from loupe.llm.tokenfile import EliasFano, Encoder, Memo, default_tokenizer, pack_segment, token_files, unpack_segments, whole_encoder

WHOLE = whole_encoder(default_tokenizer(), 2)
CHUNKS = Encoder(default_tokenizer(), 2, (Memo(7), Memo(5)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano_round_trip_and_select(sizes):
    ends = np.cumsum(sizes)
    ef = EliasFano.encode(ends)
    assert ef.all().tolist() == ends.tolist()
    assert [ef.select(i) for i in range(len(ends))] == ends.tolist()
    assert ef.lows.nbytes + ef.upper.nbytes <= len(ends) * (ef.low_bits + 3) / 8 + 24  # near l + 2 bits an entry


def test_segments_round_trip():
    rng = random.Random(5)
    blocks = []
    for n in (1, 63, 64, 200):
        sizes = [rng.randrange(0, 900) for _ in range(n)]
        ids = np.array([rng.randrange(49408) for _ in range(sum(sizes))], "<u2")
        blocks.append(([None if i == 0 else i - 5 for i in range(n)], np.cumsum(sizes), ids))
    data = b"".join(pack_segment(d, e, i.tobytes(), 2) + b"\n" for d, e, i in blocks)
    for (d, e, i), (d1, ef, i1) in zip(blocks, unpack_segments(data), strict=True):
        assert d == d1 and ef.all().tolist() == e.tolist() and i.tolist() == i1.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcXYZ019'stdlveéÉßñ İıſΣσςK \t\n\x1c\x85\xa0́<|>.,-%$"), st.characters(exclude_categories=["Cs"])), max_size=60))
@example("<|endoftext|> x<|startoftext|>y it's WE'LL don'T é É́")
def test_chunks_equal_the_whole_text(text):
    assert CHUNKS.encode(text) == WHOLE(text)


def brute(docs):
    out, start = [], 0
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(np.frombuffer(WHOLE(t), "<u2"), 1).astype("<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def rows(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_query_equals_whole_encoding(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(QUERIES["op10_token_files"](spark, sf)) == brute(docs)


def test_nulls_empty_long_repeated_many_segments_and_any_tokenizer(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 50)
    monkeypatch.setattr(tokenfile, "FILE_SEGMENTS", 2)
    docs = [(i, f"Text number {i} of the corpus" * (i % 5)) for i in range(300)] + [(None, "no id"), (-7, None), (-8, ""), (500, "long text " * 30000), (501, "same"), (501, "same")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({"id": F.lit("x"), "value": F.lit(1), "start": F.lit(2)})
    assert rows(token_files(df, default_tokenizer())) == brute(docs)
    assert rows(token_files(df, default_tokenizer(), by_chunks=False, width=4)) == brute(docs)
    assert token_files(df.limit(0), default_tokenizer()).collect() == []
