"""Licence scan by a positional index of rare words.  Only DataFrame functions.

Each licence template has a mandatory key phrase.  Document frequencies of all licence words are
counted over the corpus; the word of the key phrase with the highest IDF is the template's anchor.
The index holds, for each anchor, its postings (template, offset in it).  In a file, each occurrence
of an anchor is looked up there and gives the place where the template would start; the template's
other words are held against the file's words at the same relative positions, and the key phrase
must stand there word by word.  As every place of a phrase holds its anchor, no place is missed.

The index is of fixed size (the templates), so it is part of the plan; files are scanned row by
row, and the one shuffle is that of the few document frequencies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a word, once A-Z are lower-cased: anything but ASCII that is no letter or digit.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        """Place of the key phrase in the template's words."""
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i:i + n] == self.key_words)


# Label, the licence's usual wording, its key phrase; base ones are counted as places.
TEMPLATES = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("agpl", "gnu affero general public license version 3", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by", "licensed under cc by 4 0", "cc by"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "creative commons zero v1 0 universal", "creative commons zero"),
    Template("epl", "eclipse public license version 2 0", "eclipse public license"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "permission to use copy modify and or distribute this software"),
    Template("lgpl", "gnu lesser general public license version 3", "lesser general public license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("mpl", "mozilla public license version 2 0", "mozilla public license"),
    Template("reserved", "copyright all rights reserved", "all rights reserved"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
)


def license_words(text_col: str) -> Column:
    """Words of a text with A-Z lower-cased; null counts as empty.  lower() turns one other letter
    into an ASCII one (the Kelvin sign into k), so that is first replaced by another of its kind."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("K"), F.lit("Å"))
    return F.regexp_extract_all(F.lower(text), F.lit(LICENSE_WORD), 0)


def inverse_frequencies(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[str, float]:
    """IDF ln((1 + n) / (1 + df)) + 1 of each licence word over all documents; one row a word is collected."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(license_words(text_col), F.array(*[F.lit(w) for w in vocabulary]))
    found = dict(docs.select(F.explode(held).alias("word")).groupBy("word").count().collect())
    n = docs.count()
    return {w: math.log((1 + n) / (1 + found.get(w, 0))) + 1 for w in vocabulary}


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan_licenses(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
                  idf: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, and hits, an array of (label, base, first_word,
    n_words, coverage): all places where a template's key phrase stands, in the order of places.
    coverage is the share of the template's IDF that stands at the same relative positions.

    Null and empty texts have no words and no hits.  Ties between a phrase's words for the anchor go
    to the first.  Repeated rows and null ids are scanned like others, an empty table gives an
    empty result, and other columns of ``docs`` are not read."""
    idf = inverse_frequencies(docs, templates, text_col) if idf is None else idf
    postings = []
    for t in templates:
        k = max(range(len(t.key_words)), key=lambda i: (idf[t.key_words[i]], -i))
        postings.append(F.struct(
            F.lit(t.key_words[k]).alias("anchor"), F.lit(k).alias("offset"), F.lit(t.label).alias("label"),
            F.lit(t.base).alias("base"), F.lit(t.key).alias("key"), F.lit(len(t.key_words)).alias("key_n"),
            F.lit(t.key_at).alias("key_at"), _strings(t.words).alias("words"),
            F.array(*[F.lit(idf[w] / sum(idf[x] for x in t.words)) for w in t.words]).alias("weights")))
    index = F.array(*postings)
    anchors = _strings(sorted({max(t.key_words, key=lambda w: idf[w]) for t in templates}))
    words = F.col("words")

    def at(place: Column) -> Column:
        """The file's word at a place from 0; null outside."""
        return F.when(place >= 0, F.get(words, place))

    def align(place: Column, p: Column) -> Column:
        """The template laid where its anchor stands at ``place``."""
        start = place - p["offset"]
        shares = F.transform(p["words"], lambda w, i: F.when(at(start - p["key_at"] + i) == w, F.get(p["weights"], i)).otherwise(F.lit(0.0)))
        stands = (start >= 0) & (F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, p["key_n"]), " ") == p["key"])
        return F.when(stands, F.struct(
            p["label"].alias("label"), p["base"].alias("base"), start.cast("long").alias("first_word"),
            p["key_n"].cast("long").alias("n_words"),
            F.least(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), F.lit(1.0)).alias("coverage")))

    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull())
    looked_up = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(index, lambda p: p["anchor"] == F.get(words, i)), lambda p: align(i, p))))
    hits = F.array_sort(F.filter(looked_up, lambda h: h.isNotNull()), lambda x, y:
                        F.when(x["first_word"] < y["first_word"], -1).when(x["first_word"] > y["first_word"], 1)
                        .when(x["label"] < y["label"], -1).when(x["label"] > y["label"], 1).otherwise(0))
    none = F.array().cast("array<struct<label:string,base:boolean,first_word:bigint,n_words:bigint,coverage:double>>")
    return (docs.select(F.col(id_col).alias("id"), license_words(text_col).alias("words"))
            .select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"),
                    F.when(F.arrays_overlap(words, anchors), hits).otherwise(none).alias("hits")))


def license_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score (largest coverage) of scan_licenses()."""
    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform("base_hits", lambda h: h["first_word"])

    def joined(hits) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    return scanned.withColumn("base_hits", base).select(
        id_col, "n_words", F.size("base_hits").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined("base_hits").alias("base_labels"), joined("hits").alias("labels"),
        F.coalesce(F.round(F.array_max(F.transform("hits", lambda h: h["coverage"])), 9), F.lit(0.0)).alias("score"))
