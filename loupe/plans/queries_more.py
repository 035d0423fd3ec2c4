"""Registered queries for kNN (K1), neighbour classifiers (A21), resampling (O, U), prediction
runs (S15-S17), result rows (E10-E13, E16, E17), combined models (N9, N14) and CV (E1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loupe.functions import split
from loupe.operators import classifiers as A
from loupe.operators import dark as N
from loupe.operators import evaluate as E
from loupe.operators import metrics as M
from loupe.operators import resample as R
from loupe.session import checkpoint_dir
from loupe.sources.reports import write_report_csv
from loupe.operators.knn import knn_join
from loupe.plans.queries_model import EMB_LABELS, EMB_SQL, emb_frame, emb_predictions, r6
from loupe.plans.registry import query
from loupe.plans.spotcheck import Candidate, FittedCandidate
from loupe.sources import predictions as PR
from loupe.sources import tables as S


def gnb_sql(prefix: str, train_where: str, score_where: str) -> str:
    """CTEs ``{prefix}scored`` with a Gaussian NB fitted on ``train_where`` rows of dims."""
    p = prefix
    return f"""
{p}tr AS (SELECT * FROM dims WHERE {train_where}),
{p}ntot AS (SELECT count(DISTINCT vec_id) AS n FROM {p}tr),
{p}eps AS (SELECT 1e-9 * max(vp) AS eps FROM (SELECT j, var_pop(v) AS vp FROM {p}tr GROUP BY j)),
{p}cls AS (SELECT label, j, avg(v) AS mu, var_pop(v) + (SELECT eps FROM {p}eps) AS var FROM {p}tr GROUP BY 1, 2),
{p}prior AS (SELECT label, ln(count(DISTINCT vec_id) / (SELECT n FROM {p}ntot)) AS lp FROM {p}tr GROUP BY 1),
{p}jll AS (SELECT d.vec_id, c.label AS cls, max(pr.lp) - 0.5 * sum(ln(2 * pi() * c.var)) - sum((d.v - c.mu) * (d.v - c.mu) / (2 * c.var)) AS s
        FROM dims d JOIN {p}cls c USING (j) JOIN {p}prior pr ON pr.label = c.label WHERE {score_where} GROUP BY 1, 2),
{p}mx AS (SELECT vec_id, max(s) AS m FROM {p}jll GROUP BY 1),
{p}prob AS (SELECT j.vec_id, j.cls, exp(j.s - mx.m) / sum(exp(j.s - mx.m)) OVER (PARTITION BY j.vec_id) AS p
         FROM {p}jll j JOIN {p}mx mx USING (vec_id)),
{p}scored AS (SELECT vec_id, list(p ORDER BY CAST(cls AS INT)) AS probs, arg_max(cls, p) AS predicted, max(p) AS rate
       FROM {p}prob GROUP BY 1)"""


# ---------------------------------------------------------------- K1 / A21
@query("K1_knn_join", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS (SELECT a.vec_id AS l, b.vec_id AS r, list_distance(a.x, b.x) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT l AS left_vec_id, r AS right_vec_id, round(d, 6) AS dist, CAST(rk AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, r) AS rk FROM pairs) WHERE rk <= 5""")
def q_k1(spark, sf):
    e = S.load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    nn = knn_join(e, e, 5, "vec_id", "vec_id", x="x", exclude_self=True)
    return nn.select("left_vec_id", "right_vec_id", r6("dist").alias("dist"), F.col("rank").cast("int").alias("rank"))


@query("A21_knn_classifier", f"""WITH {EMB_SQL},
ex AS (SELECT vec_id, label, split, CAST(embedding AS DOUBLE[]) AS x FROM e),
pairs AS (SELECT q.vec_id AS qid, t.label AS tl, list_distance(q.x, t.x) AS d, t.vec_id AS tid
          FROM ex q JOIN ex t ON q.split = 'test' AND t.split = 'train'),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS rk FROM pairs) WHERE rk <= 5),
votes AS (SELECT qid, tl, count(*) AS n FROM nn GROUP BY 1, 2),
best AS (SELECT qid, tl AS predicted, n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, CAST(tl AS INT)) AS r FROM votes) WHERE r = 1)
SELECT e.vec_id, e.label, b.predicted, round(b.n / 5.0, 6) AS rate FROM e JOIN best b ON b.qid = e.vec_id""")
def q_a21(spark, sf):
    p = emb_predictions(spark, sf, "KNN")
    return p.select("vec_id", "label", E.idx_to_label(EMB_LABELS, "prediction").alias("predicted"), r6("rate").alias("rate"))


# ---------------------------------------------------------------- resampling on the embeddings training rows
_TRAIN_SQL = f"""WITH {EMB_SQL}, t AS (SELECT vec_id, label FROM e WHERE split = 'train'),
cnt AS (SELECT label, count(*) AS n FROM t GROUP BY 1),
hk AS (SELECT t.*, {split.sql_hash_unit(0, 'vec_id', 3)} AS u FROM t)"""


def _emb_train(spark, sf):
    return emb_frame(spark, sf).filter("split = 'train'")


@query("U2_random_undersample", _TRAIN_SQL + """
SELECT vec_id, label FROM (SELECT hk.*, row_number() OVER (PARTITION BY label ORDER BY u, CAST(vec_id AS VARCHAR)) AS rk FROM hk)
WHERE rk <= (SELECT min(n) FROM cnt)""")
def q_u2(spark, sf):
    return R.random_undersample(_emb_train(spark, sf), seed=0, key="vec_id").select("vec_id", "label")


@query("O2_random_oversample", _TRAIN_SQL + """,
mx AS (SELECT max(n) AS m FROM cnt),
rk AS (SELECT hk.*, row_number() OVER (PARTITION BY label ORDER BY u, CAST(vec_id AS VARCHAR)) AS r FROM hk)
SELECT rk.vec_id, rk.label, CAST((SELECT m FROM mx) // c.n + CASE WHEN rk.r <= (SELECT m FROM mx) % c.n THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM rk JOIN cnt c USING (label)""")
def q_o2(spark, sf):
    o = R.random_oversample(_emb_train(spark, sf), seed=0, key="vec_id")
    return o.groupBy("vec_id", "label").agg(F.count(F.lit(1)).alias("copies"))


@query("U4_edited_nearest_neighbours", f"""WITH {EMB_SQL},
t AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM e WHERE split = 'train'),
cnt AS (SELECT label, count(*) AS n FROM t GROUP BY 1),
minority AS (SELECT label FROM cnt ORDER BY n, CAST(label AS DOUBLE) LIMIT 1),
pairs AS (SELECT a.vec_id AS l, a.label AS la, b.label AS lb, list_distance(a.x, b.x) AS d, b.vec_id AS r
          FROM t a JOIN t b ON a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, CAST(r AS VARCHAR)) AS rk FROM pairs) WHERE rk <= 3),
agree AS (SELECT l, bool_and(la = lb) AS ok FROM nn GROUP BY 1)
SELECT t.vec_id, t.label FROM t JOIN agree a ON a.l = t.vec_id
WHERE a.ok OR t.label = (SELECT label FROM minority)""")
def q_u4(spark, sf):
    return R.edited_nn(_emb_train(spark, sf), k=3, key="vec_id").select("vec_id", "label")


# ---------------------------------------------------------------- E13 / S15-S17 prediction runs (GNB on embeddings)
_RUN_SQL = f"""WITH {EMB_SQL},{gnb_sql('', "split = 'train'", "d.split = 'test'")},
res AS (SELECT s.vec_id AS unique_key, s.predicted AS class_result, s.rate AS class_rate,
               array_to_string(list_transform(s.probs, lambda p: printf('%.6f', p)), ',') AS class_probabilities FROM scored s)"""


def _gnb_results(spark, sf):
    p = emb_predictions(spark, sf, "GNB")
    return E.prediction_results(p, "vec_id", EMB_LABELS, fmt="%.6f")


@query("E13_prediction_results", _RUN_SQL + """
SELECT unique_key, class_result, round(class_rate, 6) AS class_rate, class_probabilities FROM res""")
def q_e13(spark, sf):
    r = _gnb_results(spark, sf)
    return r.select("unique_key", "class_result", r6("class_rate").alias("class_rate"), "class_probabilities")


@query("S15_write_run", _RUN_SQL + """
SELECT 1 AS run_id, unique_key, class_result, round(class_rate, 6) AS class_rate, 'GNB' AS class_algorithm,
       (SELECT count(*) FROM res) AS row_count FROM res""")
def q_s15(spark, sf):
    """Write a run to new tables in the shared folder and read it back from there."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/loupe-runs-{uuid.uuid4().hex}"
    header = PR.header_frame(spark, PR.next_run_id(spark, f"{base}/header"), "embeddings", ["embedding"], "I", EMB_LABELS, "GNB")
    done = PR.write_run(header, PR.rows_frame(_gnb_results(spark, sf), 1), base)
    rows = spark.read.parquet(f"{base}/rows").join(spark.read.parquet(f"{base}/header"), "run_id")
    return rows.select("run_id", "unique_key", "class_result", r6("class_rate").alias("class_rate"), "class_algorithm",
                       F.lit(done["row_count"]).cast("bigint").alias("row_count"))


@query("S20_report_csv", """
SELECT c_mktsegment AS segment, replace(printf('%.2f', sum(c_acctbal)), '.', ',') AS balance,
       CASE WHEN max(c_custkey) > 0 THEN 'N/A' END AS missing FROM customer GROUP BY 1""")
def q_s20(spark, sf):
    """Write a report (decimal comma, N/A for missing) to the shared folder and read its text back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/loupe-report-{uuid.uuid4().hex}"
    c = S.load(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("balance")).withColumn("missing", F.lit(None).cast("double"))
    write_report_csv(c, path)
    return spark.read.option("sep", ";").option("header", True).schema("segment string, balance string, missing string").csv(path)


@query("S16_check_predictions", """
SELECT 'bad_rate' AS check_name, CAST(0 AS BIGINT) AS n_violations UNION ALL SELECT 'bad_rate_type', 0
UNION ALL SELECT 'duplicate_keys', 0 UNION ALL SELECT 'orphan_runs', 0""")
def q_s16(spark, sf):
    rows = PR.rows_frame(_gnb_results(spark, sf), 1)
    header = PR.header_frame(spark, 1, "embeddings", ["embedding"], "I", EMB_LABELS, "GNB")
    return PR.check_predictions(header, rows)


@query("S17_read_run", _RUN_SQL + """
SELECT e.vec_id, e.label AS true_label, 1 AS run_id, r.class_result, round(r.class_rate, 6) AS class_rate,
       'I' AS class_rate_type, 'GNB' AS class_algorithm
FROM e JOIN res r ON r.unique_key = e.vec_id""")
def q_s17(spark, sf):
    rows = PR.rows_frame(_gnb_results(spark, sf), 1)
    header = PR.header_frame(spark, 1, "embeddings", ["embedding"], "I", EMB_LABELS, "GNB")
    data = S.load(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("true_label"))
    run = S.read_run(data, rows, header, "vec_id", 1)
    return run.select("vec_id", "true_label", "run_id", "class_result", r6("class_rate").alias("class_rate"),
                      "class_rate_type", "class_algorithm")


# ---------------------------------------------------------------- E16 / E17 / N9 / N14: cross-trained vs retrained
_TWO_SQL = f"""WITH {EMB_SQL},{gnb_sql('c_', "split = 'train'", 'TRUE')},{gnb_sql('r_', 'TRUE', 'TRUE')},
pairs2 AS (SELECT e.vec_id, e.label, c.predicted AS pc, c.rate AS qc, c.probs AS vc, r.predicted AS pr, r.rate AS qr, r.probs AS vr
         FROM e JOIN c_scored c USING (vec_id) JOIN r_scored r USING (vec_id))"""


def _two_models(spark, sf):
    f = emb_frame(spark, sf)
    cross = A.fit("GNB", f.filter("split = 'train'"), 10)
    retrained = A.fit("GNB", f, 10)
    return f, cross, retrained


@query("E16_mispredicted", _TWO_SQL + """,
wrong AS (SELECT vec_id, label AS Actual,
    CASE WHEN pc <> label THEN pc ELSE pr END AS Predicted,
    CASE WHEN pc <> label THEN 'cross-trained' ELSE 'retrained' END AS Model,
    CASE WHEN pc <> label THEN vc ELSE vr END AS p,
    CASE WHEN pc <> label THEN qc ELSE qr END AS rate
  FROM pairs2 WHERE pc <> label OR pr <> label)
SELECT vec_id, Actual, Predicted, Model, round(p[1], 6) AS "P(0)", round(p[2], 6) AS "P(1)", round(rate, 6) AS rate
FROM wrong ORDER BY rate DESC, vec_id LIMIT 50""")
def q_e16(spark, sf):
    f, cross, retrained = _two_models(spark, sf)
    m = E.mispredicted(cross.transform(f), retrained.transform(f), "vec_id", EMB_LABELS, top=50)
    rate = F.greatest(*[F.col(f"`P({lab})`") for lab in EMB_LABELS])
    return m.select("vec_id", "Actual", "Predicted", "Model", r6(F.col("`P(0)`")).alias("P(0)"),
                    r6(F.col("`P(1)`")).alias("P(1)"), r6(rate).alias("rate"))


@query("E17_mispredicted_counts", _TWO_SQL + """
SELECT 'cross' AS model, count(*) FILTER (WHERE pc <> label) AS n_wrong, round(avg(CAST(pc = label AS DOUBLE)), 6) AS accuracy FROM pairs2
UNION ALL SELECT 'retrained', count(*) FILTER (WHERE pr <> label), round(avg(CAST(pr = label AS DOUBLE)), 6) FROM pairs2""")
def q_e17(spark, sf):
    f, cross, retrained = _two_models(spark, sf)
    r = E.mispredicted_counts({"cross": cross.transform(f), "retrained": retrained.transform(f)})
    return r.select("model", "n_wrong", r6("accuracy").alias("accuracy"))


@query("N9_combined_worst_case", _TWO_SQL + """,
step1 AS (SELECT *, CASE WHEN pc <> label AND qc >= 0 THEN pc ELSE label END AS l1,
                    CASE WHEN pc <> label AND qc >= 0 THEN qc ELSE 0.0 END AS p1 FROM pairs2),
step2 AS (SELECT *, CASE WHEN pr <> label AND qr >= p1 THEN pr ELSE l1 END AS l2,
                    CASE WHEN pr <> label AND qr >= p1 THEN qr ELSE p1 END AS p2 FROM step1)
SELECT vec_id, label, l2 AS combined_prediction, round(p2, 6) AS combined_rate FROM step2""")
def q_n9(spark, sf):
    f, cross, retrained = _two_models(spark, sf)
    c = E.with_rate(cross.transform(f)).select("vec_id", "label", E.idx_to_label(EMB_LABELS, "prediction").alias("pc"),
                                               F.col("rate").alias("qc"))
    r = E.with_rate(retrained.transform(f)).select("vec_id", E.idx_to_label(EMB_LABELS, "prediction").alias("pr"),
                                                   F.col("rate").alias("qr"))
    j = N.combined_worst_case(c.join(r, "vec_id"), "label", [("pc", "qc"), ("pr", "qr")])
    return j.select("vec_id", "label", "combined_prediction", r6("combined_rate").alias("combined_rate"))


@query("N14_confusion_by_model", _TWO_SQL + """,
grid AS (SELECT a.l AS actual, b.l AS predicted FROM (SELECT DISTINCT label AS l FROM e) a, (SELECT DISTINCT label AS l FROM e) b),
m AS (SELECT 'cross' AS model, label AS actual, pc AS predicted FROM pairs2 UNION ALL SELECT 'retrained', label, pr FROM pairs2)
SELECT g.actual, g.predicted, CAST(count(m.actual) AS BIGINT) AS n, mm.model FROM grid g
CROSS JOIN (SELECT 'cross' AS model UNION ALL SELECT 'retrained') mm
LEFT JOIN m ON m.actual = g.actual AND m.predicted = g.predicted AND m.model = mm.model GROUP BY 1, 2, 4""")
def q_n14(spark, sf):
    f, cross, retrained = _two_models(spark, sf)
    return N.confusion_by_model({"cross": cross.transform(f), "retrained": retrained.transform(f)}, EMB_LABELS)


# ---------------------------------------------------------------- E10 / E11: models without probabilities (NCT)
@query("E11_fallback_rates", f"""WITH {EMB_SQL},
cent AS (SELECT label, j, avg(v) AS mu FROM dims WHERE split = 'train' GROUP BY 1, 2),
dist AS (SELECT d.vec_id, c.label AS cls, sum((d.v - c.mu) * (d.v - c.mu)) AS dd
         FROM dims d JOIN cent c USING (j) WHERE d.split = 'test' GROUP BY 1, 2),
pred AS (SELECT vec_id, arg_min(cls, dd) AS predicted FROM dist GROUP BY 1),
cm AS (SELECT e.vec_id, e.label, p.predicted FROM e JOIN pred p USING (vec_id)),
prec AS (SELECT predicted, avg(CAST(label = predicted AS DOUBLE)) AS precision FROM cm GROUP BY 1)
SELECT cm.vec_id, cm.predicted, round(prec.precision, 6) AS rate, 'A' AS rate_type FROM cm JOIN prec USING (predicted)""")
def q_e11(spark, sf):
    f = emb_frame(spark, sf)
    m = A.fit("NCT", f.filter("split = 'train'"), 10)
    p = E.with_rate(m.transform(f.filter("split = 'test'")))
    rep = M.classification_report(p, EMB_LABELS)
    out = E.fallback_rates(p, rep, EMB_LABELS)
    return out.select("vec_id", E.idx_to_label(EMB_LABELS, "prediction").alias("predicted"), r6("rate").alias("rate"),
                      F.lit(E.rate_type(m.has_probability, True)).alias("rate_type"))


# ---------------------------------------------------------------- E1: cross-validation fold scores (NCT, 5 folds)
@query("E1_cross_val_fold_scores", f"""WITH {EMB_SQL},
f AS (SELECT vec_id, CAST({split.sql_hash_bits(1, 'vec_id', 1)} % 5 AS INTEGER) AS fold FROM e WHERE split = 'train'),
d2 AS (SELECT dims.*, f.fold FROM dims JOIN f USING (vec_id)),
folds AS (SELECT DISTINCT fold FROM f),
cent AS (SELECT fo.fold AS held, d.label, d.j, avg(d.v) AS mu FROM d2 d JOIN folds fo ON d.fold <> fo.fold GROUP BY 1, 2, 3),
dist AS (SELECT d.vec_id, d.fold, c.label AS cls, sum((d.v - c.mu) * (d.v - c.mu)) AS dd
         FROM d2 d JOIN cent c ON c.held = d.fold AND c.j = d.j GROUP BY 1, 2, 3),
pred AS (SELECT vec_id, fold, arg_min(cls, dd) AS predicted FROM dist GROUP BY 1, 2)
SELECT p.fold, round(avg(CAST(p.predicted = e.label AS DOUBLE)), 6) AS score FROM pred p JOIN e USING (vec_id) GROUP BY 1""")
def q_e1(spark, sf):
    f = emb_frame(spark, sf).filter("split = 'train'")
    parts = []
    for fold in range(5):
        m = A.fit("NCT", f.filter(F.col("fold") != fold), 10)
        parts.append(m.transform(f.filter(F.col("fold") == fold)))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return M.fold_scores(oof, EMB_LABELS, "accuracy").select("fold", r6("score").alias("score"))


@query("E1_cross_val_scaled", f"""WITH {EMB_SQL},
f AS (SELECT vec_id, CAST({split.sql_hash_bits(1, 'vec_id', 1)} % 5 AS INTEGER) AS fold FROM e WHERE split = 'train'),
d2 AS (SELECT dims.*, f.fold FROM dims JOIN f USING (vec_id)),
folds AS (SELECT DISTINCT fold FROM f),
sd AS (SELECT fo.fold AS held, d.j, stddev_pop(d.v) AS s FROM d2 d JOIN folds fo ON d.fold <> fo.fold GROUP BY 1, 2),
cent AS (SELECT fo.fold AS held, d.label, d.j, avg(d.v) AS mu FROM d2 d JOIN folds fo ON d.fold <> fo.fold GROUP BY 1, 2, 3),
dist AS (SELECT d.vec_id, d.fold, c.label AS cls, sum((d.v - c.mu) * (d.v - c.mu) / CASE WHEN sd.s > 0 THEN sd.s * sd.s ELSE 1 END) AS dd
         FROM d2 d JOIN cent c ON c.held = d.fold AND c.j = d.j JOIN sd ON sd.held = d.fold AND sd.j = d.j GROUP BY 1, 2, 3),
pred AS (SELECT vec_id, fold, arg_min(cls, dd) AS predicted FROM dist GROUP BY 1, 2)
SELECT p.fold, round(avg(CAST(p.predicted = e.label AS DOUBLE)), 6) AS score FROM pred p JOIN e USING (vec_id) GROUP BY 1""")
def q_e1_scaled(spark, sf):
    """Standard scaling and nearest centroid, both fitted on the other folds."""
    f = emb_frame(spark, sf).filter("split = 'train'")
    oof = None
    for fold in range(5):
        m = FittedCandidate(Candidate("STA", "NOR", "NCT"), f.filter(F.col("fold") != fold), 10, "vec_id")
        part = m.transform(f.filter(F.col("fold") == fold))
        oof = part if oof is None else oof.unionByName(part)
    return M.fold_scores(oof, EMB_LABELS, "accuracy").select("fold", r6("score").alias("score"))
