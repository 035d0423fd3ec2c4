"""Text and category features.

Two forms of the same bag-of-words features:

* **long form** ``(id, term, value)`` built from joins and grouped aggregates.  Exact, no
  vocabulary cap, checkable against SQL, and the form the composed classifiers score on.
* **vector form** for Spark ML estimators: ``CountVectorizer -> IDF -> (idf + 1) scaling ->
  Normalizer``, fitted on training rows only.

Frequent terms are hot keys: document frequencies are grouped counts (map-side partial
aggregation), and the term -> idf table is joined without a hint so AQE broadcasts it when
its measured size is small and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import (CountVectorizer, IDF, Normalizer, StringIndexer, VectorAssembler,
                                ElementwiseProduct, NGram)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions import text as TX

CATEGORY_LIMIT = 30  # fixed value


# ------------------------------------------------------------------ language
def stop_word_table(spark, languages=None) -> DataFrame:
    langs = sorted(languages or TX.LANGUAGES)
    rows = sorted({(code, w) for code in langs for w in TX.stop_words(code)})
    return spark.createDataFrame(rows, "lang string, w string")


def detect_language(df: DataFrame, id_col: str, text_col: str, languages=None,
                    default: str = TX.DEFAULT_LANGUAGE) -> DataFrame:
    """Language with the most stop-word hits per row (ties: smaller code); no hit -> default.

    The stop-word table has a fixed, small size, so it is broadcast.
    """
    sw = F.broadcast(stop_word_table(df.sparkSession, languages))
    tok = df.select(id_col, F.explode(TX.words(text_col)).alias("w"))
    hits = tok.join(sw, "w").groupBy(id_col, "lang").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy(id_col).agg(F.min_by("lang", F.struct((-F.col("n")).alias("k"), F.col("lang"))).alias("detected"))
    return (df.select(id_col).join(best, id_col, "left")
            .select(id_col, F.coalesce(F.col("detected"), F.lit(default)).alias("detected")))


def dominant_language(df: DataFrame, text_col: str, languages=None, default: str = TX.DEFAULT_LANGUAGE) -> str:
    """Language of a whole text column (the reference detects it on all text joined)."""
    sw = F.broadcast(stop_word_table(df.sparkSession, languages))
    tok = df.select(F.explode(TX.words(text_col)).alias("w"))
    r = (tok.join(sw, "w").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
         .orderBy(F.col("n").desc(), "lang").first())
    return r["lang"] if r else default


# ------------------------------------------------------------------ categories
def categorical_columns(df: DataFrame, columns: list[str], limit: int = CATEGORY_LIMIT) -> list[str]:
    """Columns with at most ``limit`` distinct values (HLL screen, exact check near the limit)."""
    if not columns:
        return []
    approx = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first().asDict()
    near = [c for c in columns if approx[c] <= 2 * limit]
    if not near:
        return []
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first().asDict()
    return [c for c in near if exact[c] <= limit]


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """X2 fit: sorted category values with 0-based codes (at most CATEGORY_LIMIT rows)."""
    vals = df.select(F.col(col).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    # a window without partitioning is fine here: at most CATEGORY_LIMIT rows reach it
    return vals.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))


def ordinal_encode(df: DataFrame, cols: list[str], fitted: dict[str, DataFrame] | None = None,
                   fit_on: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace each category column by its code; unseen values -> -1.

    The code tables are bounded by the category limit, so they are broadcast.
    """
    fitted = dict(fitted or {})
    out = df
    for c in cols:
        if c not in fitted:
            fitted[c] = category_codes(fit_on if fit_on is not None else df, c).cache()
        codes = F.broadcast(fitted[c].withColumnRenamed("value", "_v").withColumnRenamed("code", "_code"))
        out = (out.join(codes, out[c].cast("string") == codes["_v"], "left")
               .withColumn(c, F.coalesce(F.col("_code"), F.lit(-1)).cast("double")).drop("_v", "_code"))
    return out, fitted


#: Rows of one id that a task may take.
HOT_ROWS = 1000


# ------------------------------------------------------------------ bag of words, long form
def terms(df: DataFrame, id_col: str, text_cols, ngram_range=(1, 1), stop_words: str | None = None,
          extra_stop_words: tuple[str, ...] = (), encrypt: bool = False) -> DataFrame:
    """Rows (id, term) for every term occurrence: document -> tokens -> stop words -> n-grams."""
    cols = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    doc = TX.document(*cols)
    if encrypt:
        doc = TX.hex_base64_encode(doc)
    toks = TX.tokenize(doc) if not encrypt else F.filter(F.split(doc, r"\s+"), lambda w: F.length(w) >= 2)
    if stop_words:
        sw = TX.stop_words(stop_words)
        if encrypt:  # encode the stop words too (the reference forgets to)
            sw = ()
        toks = F.filter(toks, lambda t: ~F.array_contains(F.array(*[F.lit(w) for w in (*sw, *extra_stop_words)]), t)) \
            if (sw or extra_stop_words) else toks
    with_grams = add_ngrams(df.select(id_col, toks.alias("_tok")), "_tok", "_grams", *ngram_range)
    return with_grams.select(id_col, F.explode("_grams").alias("term"))


def count_by_document(df: DataFrame, id_col: str, to_terms, out_col: str) -> DataFrame:
    """(id, term, count) of ``to_terms(rows)``, whose rows are (id, term).  Texts are shuffled by id, so the
    many (id, term) pairs are counted where they arise and are not shuffled; rows of an id that is
    repeated more than ``HOT_ROWS`` times (a null id too) are spread by term."""
    count = lambda rows: to_terms(rows).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias(out_col))
    hot = F.broadcast(df.groupBy(F.col(id_col).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select("_hot"))
    is_hot = F.col(id_col).eqNullSafe(F.col("_hot"))
    return count(df.join(hot, is_hot, "left_anti").repartition(id_col)).unionByName(count(df.join(hot, is_hot, "left_semi")))


def term_counts(df: DataFrame, id_col: str, text_cols, **kw) -> DataFrame:
    """(id, term, tf) — a grouped count inside the tasks that hold a document."""
    cols = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    rows = df.select(*dict.fromkeys([id_col, *cols]))
    return count_by_document(rows, id_col, lambda part: terms(part, id_col, text_cols, **kw), "tf")


def document_frequency(tc: DataFrame, id_col: str) -> DataFrame:
    """(term, df): number of documents containing the term (tc has one row per (id, term))."""
    return tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def df_stop_words(tc: DataFrame, id_col: str, n_docs: int, threshold: float) -> DataFrame:
    """Terms whose document share is at least ``threshold`` (1.0 disables)."""
    if threshold >= 1.0:
        return tc.sparkSession.createDataFrame([], "term string")
    return document_frequency(tc, id_col).filter(F.col("df") / F.lit(n_docs) >= threshold).select("term")


def idf_table(train_tc: DataFrame, id_col: str, n_docs: int, max_df: float = 1.0) -> DataFrame:
    """X8 fit: (term, idf) with idf = ln((1 + n) / (1 + df)) + 1 on training documents;
    terms above the max_df share are dropped."""
    d = document_frequency(train_tc, id_col)
    if max_df < 1.0:
        d = d.filter(F.col("df") <= F.lit(max_df * n_docs))
    return d.select("term", (F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tf_idf(tc: DataFrame, idf: DataFrame, id_col: str, use_idf: bool = True) -> DataFrame:
    """X8/X9 transform: (id, term, weight), L2-normalised per document; unseen terms dropped."""
    j = tc.join(idf, "term", "inner")
    w = F.col("tf") * (F.col("idf") if use_idf else F.lit(1.0))
    j = j.withColumn("w", w.cast("double"))
    norms = j.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return (j.join(norms, id_col).select(id_col, "term", (F.col("w") / F.col("_norm")).alias("weight")))


# ------------------------------------------------------------------ vector form for Spark ML
class TfIdfModel:
    """Fitted vector-form TF-IDF: count vectoriser + (idf + 1) scaling + L2 normaliser."""

    def __init__(self, cv_model, scaler, norm):
        self.cv_model, self.scaler, self.norm = cv_model, scaler, norm

    @property
    def vocabulary(self):
        return self.cv_model.vocabulary

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.cv_model.transform(df)
        out = self.scaler.transform(out)
        return self.norm.transform(out).drop("_tf", "_tfidf")


#: Every term has a place in the vector form; Spark's vectors have at most this many.
VOCABULARY_MOST = 2**31 - 1


def fit_tf_idf(train: DataFrame, tokens_col: str, out_col: str = "text_features", vocab_size: int = VOCABULARY_MOST,
               max_df: float = 1.0, use_idf: bool = True) -> TfIdfModel:
    """Vector-form X7+X8 fitted on training rows only.

    Spark's IDF is ln((n+1)/(df+1)); the reference's weighting adds 1, applied here as an
    element-wise product with idf + 1 (a vector of vocabulary size).
    """
    cv = CountVectorizer(inputCol=tokens_col, outputCol="_tf", vocabSize=vocab_size, minDF=1.0,
                         maxDF=(max_df if max_df < 1.0 else float(2 ** 63 - 1)))
    cv_model = cv.fit(train)
    if use_idf:
        idf_model = IDF(inputCol="_tf", outputCol="_idf_tmp").fit(cv_model.transform(train))
        vec = Vectors.dense([v + 1.0 for v in idf_model.idf.toArray()])
    else:
        vec = Vectors.dense([1.0] * len(cv_model.vocabulary))
    scaler = ElementwiseProduct(scalingVec=vec, inputCol="_tf", outputCol="_tfidf")
    norm = Normalizer(inputCol="_tfidf", outputCol=out_col, p=2.0)
    return TfIdfModel(cv_model, scaler, norm)


def tokens_column(df: DataFrame, text_cols, out_col: str = "tokens", ngram_range=(1, 1),
                  stop_words: str | None = None, encrypt: bool = False) -> DataFrame:
    """Array column of terms (the input of the vector form)."""
    cols = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    doc = TX.document(*cols)
    if encrypt:
        doc = TX.hex_base64_encode(doc)
        toks = F.filter(F.split(doc, r"\s+"), lambda w: F.length(w) >= 2)
    else:
        toks = TX.tokenize(doc)
    if stop_words and not encrypt:
        toks = TX.remove_stop_words(toks, stop_words)
    return add_ngrams(df.withColumn("_tok", toks), "_tok", out_col, *ngram_range).drop("_tok")


def add_ngrams(df: DataFrame, tokens_col: str, out_col: str, lo: int = 1, hi: int = 1) -> DataFrame:
    """N-grams lo..hi of a materialised token column via Spark ML ``NGram`` (JVM side;
    a lambda over an unmaterialised token expression would re-tokenise per element)."""
    parts = []
    out = df
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(F.col(tokens_col))
        else:
            out = NGram(n=n, inputCol=tokens_col, outputCol=f"_ng{n}").transform(out)
            parts.append(F.col(f"_ng{n}"))
    grams = parts[0] if len(parts) == 1 else F.concat(*parts)
    return out.withColumn(out_col, grams).drop(*[f"_ng{n}" for n in range(max(lo, 2), hi + 1)])


def label_indexer(label_col: str, out_col: str = "label_idx") -> StringIndexer:
    """Sorted labels <-> 0..k-1 (labels are text, sorted alphabetically)."""
    return StringIndexer(inputCol=label_col, outputCol=out_col, stringOrderType="alphabetAsc", handleInvalid="keep")


def assemble(df: DataFrame, cols: list[str], out_col: str = "features") -> DataFrame:
    """X11: numeric + category codes + text vector, in that order."""
    return VectorAssembler(inputCols=cols, outputCol=out_col, handleInvalid="keep").transform(df)
