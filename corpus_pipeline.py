"""Cleaning a corpus: toxicity, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import keep_once, load, staged
from loupe.llm.exactdedup import exact_dedup, normalised
from loupe.llm.mixing import in_training_order, mix
from loupe.llm.packing import pack
from loupe.llm.simhash import near_groups, text_digest
from loupe.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity

#: As in the near-dedup query: three-word shingles, at most three differing bits.
SHINGLE, MAX_BITS = 3, 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = fit_toxicity(docs, load(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, name="__toxicity").where(F.col("__toxicity") < THRESHOLD).drop("__toxicity")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays; one without id if none has an id."""
    kept = exact_dedup(docs).where("kept").select("doc_id", "text_sha256")
    return keep_once(docs, kept, F.sha2(normalised("text"), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays; one without id if none
    has an id.  Of several texts with that id in the group, the one with the smallest digest stays."""
    found = near_groups(docs, SHINGLE, MAX_BITS)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group_fp", "doc_id").agg(F.min("text_sha256").alias("text_sha256"))
    return keep_once(docs, kept, text_digest("text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each copy, in training order."""
    return in_training_order(docs, mix(docs))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins; copies of a document are one duplicate cluster."""
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash_near_dedup", drop_near_copies),
          ("mix_sources", mix_sources), ("best_fit_packing", pack_bins)]

#: Training a network, components and bin packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
