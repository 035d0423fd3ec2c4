import math
import re

from pyspark.sql import functions as F

from loupe.llm.licenses import TEMPLATES, license_digest, scan_licenses
from loupe.llm.queries import QUERIES

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


def brute(docs):
    """docs: list of (id, text) -> id, n_words, n_base, first, last, base labels, labels, score."""
    every = [words_of(t) for _, t in docs]
    vocabulary = {w for t in TEMPLATES for w in t.words}
    sets = [set(w) & vocabulary for w in every]
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in s for s in sets))) + 1 for w in vocabulary}
    out = []
    for (i, _), words in zip(docs, every):
        base = [(p, label) for phrase, label in BASE.items() for p in places(words, phrase)]
        labels, score = {x for _, x in base}, 0.0
        for t in TEMPLATES:
            total = sum(idf[w] for w in t.words)
            for p in places(words, t.key):
                labels.add(t.label)
                start = p - t.key_at
                got = sum(idf[w] for k, w in enumerate(t.words) if 0 <= start + k < len(words) and words[start + k] == w)
                score = max(score, got / total)
        at = [p for p, _ in base]
        out.append((i, len(words), len(base), min(at, default=None), max(at, default=None),
                    ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 6)))
    return out


def rows(df):
    return [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 6)) for r in df.collect()]


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = rows(QUERIES["op3_license_scan"](spark, sf))
    assert sorted(got) == sorted(brute(docs))
    assert any(r[2] for r in got)


def test_planted_and_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "MIT License"), (4, "mit mit-license; MIT\nLICENSE mit  license!"),
            (5, "the GNU Lesser General Public License, version 3 and the Apache License"),
            (6, "worK general public licenſe"), (7, "KMIT License mit licenses general public license"),
            (8, "license mit"), (8, "license mit"), (None, "Apache License"),
            (9, "x " * 60000 + "Permission is hereby granted, free of charge, to any person. MIT license" + " y" * 60000),
            (10, "redistribution and use in source and binary forms, with or without modification, are permitted"),
            (11, "license"), (12, "general public license general public license version 2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"words": F.lit(1), "hits": F.lit("x"), "n_words": F.lit(2)})
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows(license_digest(scan_licenses(df))), key=key) == sorted(brute(docs), key=key)
    assert license_digest(scan_licenses(df.limit(0))).collect() == []
