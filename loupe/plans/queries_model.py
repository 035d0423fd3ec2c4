"""Registered queries for features (X), scalers (C), classifiers (A), evaluation (E, M), dark
numbers (N), kNN (K) and resampling (O, U).

SQL-checkable classifiers run on ``embeddings`` (64-d, 10 classes): the modelling frame is the
table itself with a hash split, so both engines see the same training and test rows.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loupe.functions import split, text as TX
from loupe.operators import classifiers as A
from loupe.operators import dark as N
from loupe.operators import evaluate as E
from loupe.operators import features as X
from loupe.operators import metrics as M
from loupe.operators.additive import fit_closed_form
from loupe.operators.scalers import fit_scaler
from loupe.plans.registry import query
from loupe.session import checkpoint_dir
from loupe.sources import tables as S
from loupe.sources.models import load_closed_form, save_closed_form

EMB_LABELS = [str(i) for i in range(10)]
TEST_SIZE = 0.2
SPLIT_SQL = f"CASE WHEN {split.sql_hash_unit(42, 'vec_id')} < {TEST_SIZE} THEN 'test' ELSE 'train' END"


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def emb_frame(spark, sf):
    """embeddings -> (vec_id, label, label_idx, split, fold, features)."""
    e = S.load(spark, sf, "embeddings")
    lab = F.col("label").cast("string")
    return e.select(
        "vec_id", lab.alias("label"), E.label_to_idx(EMB_LABELS, lab).alias("label_idx"),
        split.split_column(42, "vec_id", TEST_SIZE).alias("split"),
        split.fold_column(1, "vec_id", 5).alias("fold"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def emb_predictions(spark, sf, code):
    f = emb_frame(spark, sf)
    m = A.fit(code, f.filter("split = 'train'"), 10)
    return E.with_rate(m.transform(f.filter("split = 'test'")))


# SQL building blocks over embeddings ------------------------------------------------------
EMB_SQL = f"""
e AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(label AS DOUBLE) AS label_idx, {SPLIT_SQL} AS split,
             embedding FROM embeddings),
dims AS (SELECT vec_id, label, label_idx, split, CAST(unnest(embedding) AS DOUBLE) AS v,
                generate_subscripts(embedding, 1) AS j FROM e)"""

NCT_SQL = f"""WITH {EMB_SQL},
cent AS (SELECT label, j, avg(v) AS mu FROM dims WHERE split = 'train' GROUP BY 1, 2),
dist AS (SELECT d.vec_id, c.label AS cls, sum((d.v - c.mu) * (d.v - c.mu)) AS dd
         FROM dims d JOIN cent c USING (j) WHERE d.split = 'test' GROUP BY 1, 2),
pred AS (SELECT vec_id, arg_min(cls, dd) AS predicted FROM dist GROUP BY 1)
"""

GNB_SQL = f"""WITH {EMB_SQL},
tr AS (SELECT * FROM dims WHERE split = 'train'),
ntot AS (SELECT count(DISTINCT vec_id) AS n FROM tr),
eps AS (SELECT 1e-9 * max(vp) AS eps FROM (SELECT j, var_pop(v) AS vp FROM tr GROUP BY j)),
cls AS (SELECT label, j, avg(v) AS mu, var_pop(v) + (SELECT eps FROM eps) AS var FROM tr GROUP BY 1, 2),
prior AS (SELECT label, ln(count(DISTINCT vec_id) / (SELECT n FROM ntot)) AS lp FROM tr GROUP BY 1),
jll AS (SELECT d.vec_id, c.label AS cls, max(p.lp) - 0.5 * sum(ln(2 * pi() * c.var)) - sum((d.v - c.mu) * (d.v - c.mu) / (2 * c.var)) AS s
        FROM dims d JOIN cls c USING (j) JOIN prior p ON p.label = c.label WHERE d.split = 'test' GROUP BY 1, 2),
mx AS (SELECT vec_id, max(s) AS m FROM jll GROUP BY 1),
prob AS (SELECT j.vec_id, j.cls, exp(j.s - mx.m) / sum(exp(j.s - mx.m)) OVER (PARTITION BY j.vec_id) AS p
         FROM jll j JOIN mx USING (vec_id)),
pv AS (SELECT vec_id, list(p ORDER BY CAST(cls AS INT)) AS probs, arg_max(cls, p) AS predicted, max(p) AS rate
       FROM prob GROUP BY 1),
scored AS (SELECT e.vec_id, e.label, e.label_idx, pv.predicted, CAST(pv.predicted AS DOUBLE) AS prediction, pv.rate, pv.probs
           FROM e JOIN pv USING (vec_id))
"""


# ---------------------------------------------------------------- X: features
@query("X1_categorical_columns", """
SELECT column_name, n_distinct, n_distinct <= 30 AS is_categorical FROM (
  SELECT 'lang' AS column_name, count(DISTINCT lang) AS n_distinct FROM documents
  UNION ALL SELECT 'source', count(DISTINCT source) FROM documents
  UNION ALL SELECT 'n_chars', count(DISTINCT n_chars) FROM documents)""")
def q_x1(spark, sf):
    d = S.load(spark, sf, "documents")
    cols = ["lang", "source", "n_chars"]
    cats = set(X.categorical_columns(d, cols))
    counts = d.agg(*[F.count_distinct(c).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("n_distinct"),
                     F.lit(c in cats).alias("is_categorical")) for c in cols]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("X2_ordinal_encode", """
SELECT c.c_custkey, CAST(k.code AS DOUBLE) AS segment_code FROM customer c
JOIN (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS value FROM customer
      WHERE c_mktsegment IS NOT NULL)) k ON c.c_mktsegment = k.value""")
def q_x2(spark, sf):
    c = S.load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    out, _ = X.ordinal_encode(c, ["c_mktsegment"])
    return out.select("c_custkey", F.col("c_mktsegment").alias("segment_code"))


@query("X3_document", """
SELECT conv_id, turn, concat_ws(' ', coalesce(CAST(role AS VARCHAR), 'None'), coalesce(CAST(text AS VARCHAR), 'None')) AS document
FROM conversations""")
def q_x3(spark, sf):
    c = S.load(spark, sf, "conversations")
    return c.select("conv_id", "turn", TX.document("role", "text").alias("document"))


@query("X4_tokenize", r"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents)""")
def q_x4(spark, sf):
    d = S.load(spark, sf, "documents")
    t = TX.tokenize("text")
    return d.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"),
                    F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


def _x5_sql():
    return rf"""
SELECT doc_id, CAST(len(list_filter(t, lambda w: NOT list_contains({TX.sql_string_list(TX.stop_words('en'))}, w))) AS BIGINT) AS n_kept
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM documents)"""


@query("X5_remove_stop_words", _x5_sql)
def q_x5(spark, sf):
    d = S.load(spark, sf, "documents")
    return d.select("doc_id", F.size(TX.remove_stop_words(TX.tokenize("text"), "en")).cast("bigint").alias("n_kept"))


@query("X6_ngrams", r"""
SELECT doc_id, term, count(*) AS n FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents)
  WHERE len(t) >= 2)
GROUP BY 1, 2""")
def q_x6(spark, sf):
    def grams(docs):
        g = X.add_ngrams(docs.select("doc_id", TX.tokenize("text").alias("tokens")), "tokens", "grams", 2, 2)
        return g.select("doc_id", F.explode("grams").alias("term"))

    return X.count_by_document(S.load(spark, sf, "documents").select("doc_id", "text"), "doc_id", grams, "n")


@query("X7_term_counts", r"""
SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents)
GROUP BY 1, 2""")
def q_x7(spark, sf):
    return X.term_counts(S.load(spark, sf, "documents"), "doc_id", "text")


_TFIDF_SQL = rf"""
WITH tc AS (SELECT doc_id, term, count(*) AS tf FROM (
       SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents) GROUP BY 1, 2),
tr AS (SELECT doc_id FROM labels WHERE {split.sql_hash_unit(42, 'doc_id')} >= {TEST_SIZE}),
n AS (SELECT count(*) AS n FROM tr),
dfreq AS (SELECT term, count(*) AS df FROM tc WHERE doc_id IN (SELECT doc_id FROM tr) GROUP BY 1),
idf AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1.0 AS idf FROM dfreq),
w AS (SELECT tc.doc_id, tc.term, tc.tf * {{IDF}} AS w FROM tc JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY 1)
SELECT doc_id, term, round(w / nrm, 6) AS weight FROM w JOIN nrm USING (doc_id)"""


def _tfidf(spark, sf, use_idf):
    d = S.load(spark, sf, "documents")
    tc = X.term_counts(d, "doc_id", "text")
    tr_ids = S.load(spark, sf, "labels").filter(split.hash_unit(42, "doc_id") >= TEST_SIZE).select("doc_id")
    tr_tc = tc.join(tr_ids, "doc_id", "left_semi")
    n = tr_ids.count()
    idf = X.idf_table(tr_tc, "doc_id", n)
    return X.tf_idf(tc, idf, "doc_id", use_idf=use_idf).select("doc_id", "term", r6("weight").alias("weight"))


@query("X8_tf_idf", _TFIDF_SQL.replace("{IDF}", "idf.idf"))
def q_x8(spark, sf):
    return _tfidf(spark, sf, True)


@query("X9_tf_only", _TFIDF_SQL.replace("{IDF}", "1.0"))
def q_x9(spark, sf):
    return _tfidf(spark, sf, False)


@query("X10_df_stop_words", r"""
WITH tc AS (SELECT DISTINCT doc_id, term FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents))
SELECT term FROM tc GROUP BY term HAVING count(*) / (SELECT count(*) FROM documents) >= 0.5""")
def q_x10(spark, sf):
    d = S.load(spark, sf, "documents")
    tc = X.term_counts(d, "doc_id", "text")
    return X.df_stop_words(tc, "doc_id", d.count(), 0.5)


@query("X12_label_encode", """
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_idx
FROM (SELECT DISTINCT trim(o_orderpriority) AS label FROM orders WHERE o_orderpriority IS NOT NULL)""")
def q_x12(spark, sf):
    o = S.load(spark, sf, "orders")
    m = X.label_indexer("o_orderpriority").fit(o)
    return spark.createDataFrame([(lab, float(i)) for i, lab in enumerate(m.labels)], "label string, label_idx double")


# ---------------------------------------------------------------- C: scalers (lineitem numerics)
_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scaled(spark, sf, code):
    li = S.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_LI)
    v = X.assemble(li, _LI)
    out = fit_scaler(code, v).transform(v)
    arr = vector_to_array(F.col("features"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      *[r6(arr[i]).alias(c) for i, c in enumerate(_LI)])


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_C_SQL = {
    "C2_standard_scale": ", ".join(f"round({c} / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END, 6) AS {c}" for c in _LI),
    "C3_minmax_scale": ", ".join(f"round(({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () > min({c}) OVER () THEN max({c}) OVER () - min({c}) OVER () ELSE 1 END, 6) AS {c}" for c in _LI),
    "C4_maxabs_scale": ", ".join(f"round({c} / CASE WHEN max(abs({c})) OVER () > 0 THEN max(abs({c})) OVER () ELSE 1 END, 6) AS {c}" for c in _LI),
    "C5_normalize": ", ".join(f"round({c} / CASE WHEN sqrt({' + '.join(x + '*' + x for x in _LI)}) > 0 THEN sqrt({' + '.join(x + '*' + x for x in _LI)}) ELSE 1 END, 6) AS {c}" for c in _LI),
    "C6_binarize": ", ".join(f"CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END AS {c}" for c in _LI),
    "C1_no_scaling": ", ".join(f"round({c}, 6) AS {c}" for c in _LI),
}
_C_CODE = {"C1_no_scaling": "NOS", "C2_standard_scale": "STA", "C3_minmax_scale": "MIX", "C4_maxabs_scale": "MAX",
           "C5_normalize": "NRM", "C6_binarize": "BIN"}
for _name, _code in _C_CODE.items():
    query(_name, f"SELECT {_KEYS}, {_C_SQL[_name]} FROM lineitem")(
        (lambda code: (lambda spark, sf: _scaled(spark, sf, code)))(_code))


# ---------------------------------------------------------------- A: classifiers on embeddings
@query("A1_dummy", f"""WITH {EMB_SQL},
cnt AS (SELECT label, count(*) AS n FROM e WHERE split = 'train' GROUP BY 1),
top AS (SELECT label FROM cnt ORDER BY n DESC, CAST(label AS INT) LIMIT 1)
SELECT vec_id, label, (SELECT label FROM top) AS predicted,
       round((SELECT max(n) FROM cnt) / (SELECT sum(n) FROM cnt), 6) AS rate
FROM e WHERE split = 'test'""")
def q_a1(spark, sf):
    p = emb_predictions(spark, sf, "DUMY")
    return p.select("vec_id", "label", E.idx_to_label(EMB_LABELS, "prediction").alias("predicted"), r6("rate").alias("rate"))


@query("A18_nearest_centroid", NCT_SQL + "SELECT e.vec_id, e.label, p.predicted FROM e JOIN pred p USING (vec_id)")
def q_a18(spark, sf):
    p = emb_predictions(spark, sf, "NCT")
    return p.select("vec_id", "label", E.idx_to_label(EMB_LABELS, "prediction").alias("predicted"))


@query("A14_gaussian_nb", GNB_SQL + "SELECT vec_id, label, predicted, round(rate, 6) AS rate FROM scored")
def q_a14(spark, sf):
    p = emb_predictions(spark, sf, "GNB")
    return p.select("vec_id", "label", E.idx_to_label(EMB_LABELS, "prediction").alias("predicted"), r6("rate").alias("rate"))


@query("S21_saved_model_scores", GNB_SQL + "SELECT vec_id, label, predicted, round(rate, 6) AS rate FROM scored")
def q_s21(spark, sf):
    """Gaussian NB, saved as a table and scored after it is read back."""
    f = emb_frame(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/loupe-models-{uuid.uuid4().hex}"
    save_closed_form(spark, path, "gnb", fit_closed_form("GNB", f.filter("split = 'train'"), len(EMB_LABELS)))
    p = E.with_rate(load_closed_form(spark, path, "gnb").transform(f.filter("split = 'test'")))
    return p.select("vec_id", "label", E.idx_to_label(EMB_LABELS, "prediction").alias("predicted"), r6("rate").alias("rate"))


# ---------------------------------------------------------------- E / M: evaluation
_NCT_LONG = NCT_SQL + """, cm AS (SELECT e.label AS actual, p.predicted FROM e JOIN pred p USING (vec_id)),
grid AS (SELECT a.l AS actual, b.l AS predicted FROM (SELECT DISTINCT label AS l FROM e) a, (SELECT DISTINCT label AS l FROM e) b),
conf AS (SELECT g.actual, g.predicted, CAST(count(cm.actual) AS BIGINT) AS n FROM grid g
         LEFT JOIN cm ON cm.actual = g.actual AND cm.predicted = g.predicted GROUP BY 1, 2)
"""


@query("E14_confusion_matrix", _NCT_LONG + "SELECT actual, predicted, n FROM conf")
def q_e14(spark, sf):
    return M.confusion_long(emb_predictions(spark, sf, "NCT"), EMB_LABELS)


_REPORT_SQL = _NCT_LONG + """,
pc AS (SELECT l AS label,
         (SELECT sum(n) FROM conf WHERE actual = l AND predicted = l) AS tp,
         (SELECT sum(n) FROM conf WHERE actual = l) AS support,
         (SELECT sum(n) FROM conf WHERE predicted = l) AS n_pred
       FROM (SELECT DISTINCT label AS l FROM e)),
pr AS (SELECT label, tp, support, n_pred,
         CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr
      WHERE support > 0 OR n_pred > 0)
"""


@query("E15_classification_report", _REPORT_SQL + """
SELECT label AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def q_e15(spark, sf):
    r = M.classification_report(emb_predictions(spark, sf, "NCT"), EMB_LABELS)
    return r.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@query("M1_M13_label_metrics", _REPORT_SQL + """,
agg AS (SELECT sum(support) AS n, sum(tp) AS c, avg(CASE WHEN support > 0 THEN recall END) AS bal,
          count(*) FILTER (WHERE support > 0) AS kt, avg(precision) AS pm, avg(recall) AS rm, avg(f1) AS fm,
          sum(precision * support) / sum(support) AS pw, sum(recall * support) / sum(support) AS rw,
          sum(f1 * support) / sum(support) AS fw, sum(support * n_pred) AS tps, sum(n_pred * n_pred) AS pp,
          sum(support * support) AS tt FROM f)
SELECT round(c / n, 6) AS accuracy, round(bal, 6) AS balanced_accuracy,
  round(CASE WHEN kt > 1 THEN (bal - 1.0 / kt) / (1 - 1.0 / kt) ELSE 0 END, 6) AS balanced_accuracy_adjusted,
  round(c / n, 6) AS f1_micro, round(fm, 6) AS f1_macro, round(fw, 6) AS f1_weighted,
  round(c / n, 6) AS recall_micro, round(rm, 6) AS recall_macro, round(rw, 6) AS recall_weighted,
  round(c / n, 6) AS precision_micro, round(pm, 6) AS precision_macro, round(pw, 6) AS precision_weighted,
  round((c * n - tps) / sqrt((n * n - pp) * (n * n - tt)), 6) AS mcc FROM agg""")
def q_m1(spark, sf):
    m = M.label_metrics(emb_predictions(spark, sf, "NCT"), EMB_LABELS)
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("M17_auc_ovo", GNB_SQL + """,
pairs AS (SELECT a.i AS a, b.i AS b FROM range(10) a(i), range(10) b(i) WHERE a.i <> b.i),
sc AS (SELECT pairs.a, pairs.b, s.probs[pairs.a + 1] AS s, CAST(s.label_idx = pairs.a AS INT) AS pos
       FROM scored s JOIN pairs ON s.label_idx IN (pairs.a, pairs.b)),
rk AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY s) + (count(*) OVER (PARTITION BY a, b, s) - 1) / 2.0 AS r FROM sc),
u AS (SELECT a, b, (sum(r) FILTER (WHERE pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(1 - pos)) AS auc
      FROM rk GROUP BY 1, 2),
sym AS (SELECT least(a, b) AS i, greatest(a, b) AS j, avg(auc) AS auc FROM u GROUP BY 1, 2)
SELECT round(avg(auc), 6) AS auc FROM sym""")
def q_m17(spark, sf):
    return M.auc_ovo(emb_predictions(spark, sf, "GNB"), 10).select(r6("auc").alias("auc"))


@query("M14_M16_average_precision", GNB_SQL + """,
cells AS (SELECT c.i AS c, s.probs[c.i + 1] AS p, CAST(s.label_idx = c.i AS INT) AS pos FROM scored s, range(10) c(i)),
pooled AS (SELECT c, p, pos FROM cells UNION ALL SELECT -1, p, pos FROM cells),
dv AS (SELECT c, p, sum(pos) AS pos, count(*) - sum(pos) AS neg FROM pooled GROUP BY 1, 2),
cum AS (SELECT c, p, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM dv
        WINDOW w AS (PARTITION BY c ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap AS (SELECT c, CASE WHEN sum(pos) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) ELSE 0 END AS ap, sum(pos) AS P FROM cum GROUP BY 1)
SELECT round(max(ap) FILTER (WHERE c = -1), 6) AS average_precision_micro,
       round(avg(ap) FILTER (WHERE c >= 0), 6) AS average_precision_macro,
       round(sum(ap * P) FILTER (WHERE c >= 0) / sum(P) FILTER (WHERE c >= 0), 6) AS average_precision_weighted FROM ap""")
def q_m14(spark, sf):
    a = M.average_precision(emb_predictions(spark, sf, "GNB"), 10)
    return a.select(*[r6(c).alias(c) for c in a.columns])


@query("E12_rates_summary", GNB_SQL + "SELECT round(avg(rate), 6) AS mean_rate, round(stddev_pop(rate), 6) AS std_rate FROM scored")
def q_e12(spark, sf):
    r = E.rates_summary(emb_predictions(spark, sf, "GNB"))
    return r.select(r6("mean_rate").alias("mean_rate"), r6("std_rate").alias("std_rate"))


@query("F7_prediction_value_counts", GNB_SQL + "SELECT predicted, count(*) AS n_rows FROM scored GROUP BY 1")
def q_f7b(spark, sf):
    p = emb_predictions(spark, sf, "GNB")
    return p.groupBy(E.idx_to_label(EMB_LABELS, "prediction").alias("predicted")).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- N: dark numbers (GNB on embeddings)
_DARK_SQL = GNB_SQL + """,
t AS (SELECT DISTINCT label AS target FROM scored),
c AS (SELECT t.target,
  count(*) FILTER (WHERE s.label <> t.target AND s.predicted <> t.target) AS TN,
  count(*) FILTER (WHERE s.label <> t.target AND s.predicted = t.target) AS FP,
  count(*) FILTER (WHERE s.label = t.target AND s.predicted <> t.target) AS FN,
  count(*) FILTER (WHERE s.label = t.target AND s.predicted = t.target) AS TP,
  avg(s.rate) FILTER (WHERE (s.label = t.target) <> (s.predicted = t.target)) AS aw,
  avg(s.rate) FILTER (WHERE s.label <> t.target AND s.predicted = t.target) AS afp,
  avg(s.rate) FILTER (WHERE s.label = t.target AND s.predicted <> t.target) AS afn
  FROM t, scored s GROUP BY 1),
r AS (SELECT *, CASE WHEN TN + FP > 0 THEN TN / (TN + FP) ELSE -1 END AS tnr, CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE -1 END AS tpr,
        CASE WHEN FP > 0 THEN aw ELSE 1.0 END AS a1, CASE WHEN FP > 0 THEN afp ELSE 1.0 END AS a_fp,
        CASE WHEN FN > 0 THEN afn ELSE 1.0 END AS a_fn FROM c)
"""


@query("N1_one_vs_rest_counts", _DARK_SQL + """
SELECT target, CAST(TN AS BIGINT) AS TN, CAST(FP AS BIGINT) AS FP, CAST(FN AS BIGINT) AS FN, CAST(TP AS BIGINT) AS TP,
       round(tnr, 6) AS TNr, round(tpr, 6) AS TPr FROM r""")
def q_n1(spark, sf):
    r = N.rates(N.one_vs_rest_counts(emb_predictions(spark, sf, "GNB"), EMB_LABELS))
    return r.select("target", "TN", "FP", "FN", "TP", r6("TNr").alias("TNr"), r6("TPr").alias("TPr"))


@query("N8_dark_numbers", _DARK_SQL + """
SELECT 'cross' AS model_type, 'base' AS type, target, [1.0] AS alphas, 1.0 AS corr, round((1 - tnr) * (2 - tpr), 6) AS dark_number FROM r
UNION ALL SELECT 'cross', 'single_alpha', target, [round(a1, 6)], 1.0, round(a1 * (1 - tnr) * (2 - tpr), 6) FROM r
UNION ALL SELECT 'cross', 'separated_alpha', target, [round(a_fp, 6), round(a_fn, 6)], 1.0, round(a_fp * (1 - tnr) * a_fn * (2 - tpr), 6) FROM r
UNION ALL SELECT 'cross', 'non_linear', target, [1.0], 1.0,
  round(CASE WHEN tnr >= 0 AND tpr >= 0 THEN (1 - pow(tnr, 1.0 / 3)) * (2 - pow(tpr, 1.0 / 3)) END, 6) FROM r
UNION ALL SELECT 'cross', 'non_linear_alpha', target, [round(a1, 6)], 1.0,
  round(CASE WHEN tnr >= 0 AND tpr >= 0 THEN (1 - pow(tnr, 1.0 / 3)) * (2 - pow(tpr, 1.0 / 3)) END * a1, 6) FROM r""")
def q_n8(spark, sf):
    d = N.dark_numbers(emb_predictions(spark, sf, "GNB"), EMB_LABELS)
    return d.select("model_type", "type", "target", F.transform("alphas", lambda a: F.round(a, 6)).alias("alphas"),
                    "corr", r6("dark_number").alias("dark_number"))
