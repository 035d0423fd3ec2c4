"""From a raw table to the modelling frame.

``prepare`` returns ONE frame with columns ``id, label, label_idx, split, fold, features``:
labelled rows carry a hash split ('train'/'test') and fold, unlabelled rows are 'predict'.
Train/test/folds are filters on this frame, never copies.  Converters (category codes,
TF-IDF) are fitted on training rows only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions import clean
from loupe.functions.split import fold_column, split_column
from loupe.operators import features as X
from loupe.operators import profile
from loupe.operators.evaluate import label_to_idx
from loupe.operators.typing import apply_types, infer_types
from loupe.sources.tables import CATEGORY_LIMIT, mode_filter, read_table
from loupe.spec import SpotCheckSpec


@dataclass
class Prepared:
    frame: DataFrame
    labels: list[str]
    n_folds: int
    id_col: str
    converters: dict = field(default_factory=dict)

    def train(self) -> DataFrame:
        return self.frame.filter(F.col("split") == "train")

    def test(self) -> DataFrame:
        return self.frame.filter(F.col("split") == "test")

    def labelled(self) -> DataFrame:
        return self.frame.filter(F.col("split") != "predict")

    def unlabelled(self) -> DataFrame:
        return self.frame.filter(F.col("split") == "predict")


def class_labels(df: DataFrame, label: str, limit: int = CATEGORY_LIMIT) -> list[str]:
    """Distinct trimmed non-blank labels, sorted (bounded by the class limit)."""
    rows = (df.select(clean.clean_label(label).alias("l")).filter(F.col("l").isNotNull()).distinct()
            .limit(limit + 1).collect())
    labels = sorted(r["l"] for r in rows)
    if len(labels) > limit:
        raise ValueError(f"class column has more than {limit} values")
    return labels


def prepare(df: DataFrame, spec: SpotCheckSpec, persist: bool = True) -> Prepared:
    t = spec.table
    base = read_table(df, t)
    base = mode_filter(base, t.label, spec.train, spec.predict)
    if spec.data_limit:
        from loupe.sources.tables import sample_n
        base = sample_n(base, spec.data_limit, t.id, spec.seed)
    base = base.withColumn(t.id, clean.normalise_key(t.id)).withColumn(t.label, clean.clean_label(t.label))
    labels = class_labels(base, t.label, spec.category_limit)
    if not labels:
        raise ValueError("no labelled rows")
    n_min = profile.smallest_class_size(base.filter(F.col(t.label).isNotNull()), t.label).first()["n_min"]
    n_folds, _ = profile.cv_folds(n_min, spec.test_size, max_folds=spec.max_folds)
    n_folds = max(2, n_folds)
    labelled = F.col(t.label).isNotNull()
    base = (base.withColumn("label_idx", label_to_idx(labels, t.label))
            .withColumn("split", F.when(labelled, split_column(spec.seed, t.id, spec.test_size)).otherwise("predict"))
            .withColumn("fold", F.when(labelled, fold_column(spec.fold_seed, t.id, n_folds))))
    conv: dict = {}
    feature_cols: list[str] = []
    text_cols = list(t.text)

    # numeric columns: whole-column typing (one aggregate on training rows), then missing -> 0
    if t.numeric:
        decisions = infer_types(base.filter(F.col("split") == "train"), list(t.numeric))
        base = apply_types(base, decisions, keep=[c for c in base.columns if c not in t.numeric])
        for c in t.numeric:
            base = base.withColumn(c, clean.impute_zero(c))
        feature_cols += list(t.numeric)

    # the cleaned (and tokenised) base is read by every converter fit: persist it once,
    # spilling to disk, and release it when the modelling frame is materialised
    lang = spec.language
    if text_cols and spec.stop_words and not lang:
        lang = X.dominant_language(base.filter(F.col("split") == "train"), text_cols[0])
    # a small table stored as one or two files would run every later pass (tokenising, each
    # optimiser iteration) on that many tasks: spread it over the cores by key.  A large
    # table already has at least that many scan partitions and keeps them (no shuffle).
    par = base.sparkSession.sparkContext.defaultParallelism
    if base.rdd.getNumPartitions() < par:
        base = base.repartition(par, t.id)
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    src = base
    train_rows = base.filter(F.col("split") == "train")

    # category columns: declared ones plus text columns with few values
    cats = list(t.categorical)
    if spec.categorize and spec.train and text_cols:
        auto = X.categorical_columns(train_rows, text_cols, spec.category_limit)
        cats += auto
        text_cols = [c for c in text_cols if c not in auto]
    if cats:
        base, fitted = X.ordinal_encode(base, cats, fit_on=train_rows)
        conv["categories"] = fitted
        conv["category_positions"] = list(range(len(feature_cols), len(feature_cols) + len(cats)))
        feature_cols += cats

    # text: one document per row -> terms -> TF-IDF fitted on training rows
    if text_cols:
        tok = X.tokens_column(base, text_cols, "tokens", spec.ngram_range, lang if spec.stop_words else None,
                              spec.encrypt_text).drop(*text_cols).persist(StorageLevel.MEMORY_AND_DISK)
        tfidf = X.fit_tf_idf(tok.filter(F.col("split") == "train"), "tokens", "text_features",
                             max_df=spec.max_df, vocab_size=spec.extra.get("vocab_size", X.VOCABULARY_MOST))
        base = tfidf.transform(tok).drop("tokens")
        conv["tfidf"] = tfidf
        conv["language"] = lang
        feature_cols.append("text_features")
    else:
        tok = None

    frame = X.assemble(base, feature_cols, "features").select(
        F.col(t.id).alias(t.id), F.col(t.label).alias("label"), "label_idx", "split", "fold", "features")
    if persist:
        frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
        frame.count()
        src.unpersist()
        if tok is not None:
            tok.unpersist()
    conv["feature_cols"] = feature_cols
    return Prepared(frame, labels, n_folds, t.id, conv)
