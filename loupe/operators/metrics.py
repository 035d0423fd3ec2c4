"""Evaluation tables and metrics.

Input: a prediction frame with ``label_idx`` (truth), ``prediction`` and optionally
``probability`` (array<double>).  The confusion matrix is one grouped count (at most k*k
rows leave each task); every label metric is then arithmetic over that k x k table.

Ranking metrics (AUC, average precision) need cumulative counts along the score order.  They
never sort the rows in one task: rows are first pre-aggregated to distinct (group, score)
values, range-partitioned by score, per-range totals give each range its offset, and the
cumulative sums run inside each range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.session import staged

LABEL, PRED, PROB = "label_idx", "prediction", "probability"


def label_grid(spark, labels: list[str]) -> DataFrame:
    """All (actual, predicted) pairs of the k labels (k <= 30: at most 900 rows)."""
    rows = [(float(i), a, float(j), p) for i, a in enumerate(labels) for j, p in enumerate(labels)]
    return F.broadcast(spark.createDataFrame(rows, "a_idx double, actual string, p_idx double, predicted string"))


def confusion_long(pred: DataFrame, labels: list[str]) -> DataFrame:
    """E14 long form: (actual, predicted, n) for every label pair, zeros included."""
    counts = pred.groupBy(F.col(LABEL).alias("a_idx"), F.col(PRED).alias("p_idx")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = label_grid(pred.sparkSession, labels)
    return (grid.join(F.broadcast(counts), ["a_idx", "p_idx"], "left")
            .select("actual", "predicted", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def confusion_pivot(pred: DataFrame, labels: list[str]) -> DataFrame:
    """E14 pivoted: one row per actual label, one column per predicted label."""
    return (confusion_long(pred, labels).groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))
            .orderBy("actual"))


def per_class(pred: DataFrame, labels: list[str]) -> DataFrame:
    """tp, support (true count) and predicted count per label."""
    cm = confusion_long(pred, labels)
    tp = cm.filter(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("label"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_pred"))
    return tp.join(sup, "label").join(prd, "label")


def classification_report(pred: DataFrame, labels: list[str]) -> DataFrame:
    """precision/recall/f1/support per class, plus accuracy, macro and weighted avg."""
    pc = per_class(pred, labels)
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    rows = pc.select("label", p.alias("precision"), r.alias("recall"), "support", "n_pred", "tp")
    rows = rows.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                           .otherwise(0.0))
    present = rows.filter((F.col("support") > 0) | (F.col("n_pred") > 0))
    tot = present.agg(F.sum("support").alias("s"), F.sum("tp").alias("t"), F.count(F.lit(1)).alias("k"),
                      F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                      (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                      (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                      (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    per = rows.select(F.col("label").alias("class"), "precision", "recall", "f1",
                      F.col("support").cast("bigint").alias("support"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("t") / F.col("s")).alias("f1"),
                     F.col("s").cast("bigint").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                     F.col("mf").alias("f1"), F.col("s").cast("bigint").alias("support"))
    wei = tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                     F.col("wf").alias("f1"), F.col("s").cast("bigint").alias("support"))
    return per.unionByName(acc).unionByName(mac).unionByName(wei)


def label_metrics(pred: DataFrame, labels: list[str]) -> DataFrame:
    """M1-M13 in one row, all from the k x k confusion table."""
    rows = per_class(pred, labels)
    present = rows.filter((F.col("support") > 0) | (F.col("n_pred") > 0))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    x = present.select("tp", "support", "n_pred", p.alias("p"), r.alias("r"), f1.alias("f"))
    s = F.sum("support").cast("double")
    agg = x.agg(
        s.alias("n"), F.sum("tp").cast("double").alias("c"),
        F.avg(F.when(F.col("support") > 0, F.col("r"))).alias("bal"),
        F.count_if(F.col("support") > 0).alias("k_true"),
        F.avg("p").alias("p_macro"), F.avg("r").alias("r_macro"), F.avg("f").alias("f_macro"),
        (F.sum(F.col("p") * F.col("support")) / s).alias("p_w"),
        (F.sum(F.col("r") * F.col("support")) / s).alias("r_w"),
        (F.sum(F.col("f") * F.col("support")) / s).alias("f_w"),
        F.sum(F.col("support") * F.col("n_pred")).cast("double").alias("tp_sum"),
        F.sum(F.col("n_pred") * F.col("n_pred")).cast("double").alias("pp"),
        F.sum(F.col("support") * F.col("support")).cast("double").alias("tt"))
    acc = F.col("c") / F.col("n")
    kt = F.col("k_true").cast("double")
    mcc_den = F.sqrt((F.col("n") * F.col("n") - F.col("pp")) * (F.col("n") * F.col("n") - F.col("tt")))
    return agg.select(
        acc.alias("accuracy"),
        F.col("bal").alias("balanced_accuracy"),
        F.when(kt > 1, (F.col("bal") - 1.0 / kt) / (1.0 - 1.0 / kt)).otherwise(0.0).alias("balanced_accuracy_adjusted"),
        acc.alias("f1_micro"), F.col("f_macro").alias("f1_macro"), F.col("f_w").alias("f1_weighted"),
        acc.alias("recall_micro"), F.col("r_macro").alias("recall_macro"), F.col("r_w").alias("recall_weighted"),
        acc.alias("precision_micro"), F.col("p_macro").alias("precision_macro"), F.col("p_w").alias("precision_weighted"),
        F.when(mcc_den > 0, (F.col("c") * F.col("n") - F.col("tp_sum")) / mcc_den).otherwise(0.0).alias("mcc"))


# ------------------------------------------------------------------ ranking metrics
def cumulative_below(df: DataFrame, group: list[str], score: str, counts: list[str]) -> DataFrame:
    """For each distinct (group, score): sums of ``counts`` over strictly smaller scores.

    ``df`` must already hold one row per distinct (group, score).  Range partitioning keeps
    equal scores together and balances the ranges; only per-range totals (ranges x groups
    rows) meet in one window.  Range borders are sampled, so two evaluations need not agree on
    them: the ranged rows are written once with their range number, and totals and running sums
    both read that.
    """
    ranged = staged(df.repartitionByRange(*group, score).withColumn("_pid", F.spark_partition_id()), "ranges")
    tot = ranged.groupBy(*group, "_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
    wo = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*group, "_pid", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                                         for c in counts])
    wi = Window.partitionBy(*group, "_pid").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.select("*", *[F.coalesce(F.sum(c).over(wi), F.lit(0)).alias(f"_i_{c}") for c in counts])
    out = inner.join(F.broadcast(offs), [*group, "_pid"])
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(f"below_{c}") for c in counts])


def _pair_scores(pred: DataFrame, k: int) -> DataFrame:
    """Rows (a, b, s, pos, neg) for every ordered class pair, pre-aggregated by score value.

    One pass: a row of class y is a positive of every pair (y, b) scored by p[y], and a
    negative of every pair (a, y) scored by p[a]; 2(k-1) exploded rows, no union per pair."""
    y = F.col(LABEL).cast("int")
    if k <= 2:
        rows = pred.select(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col(PROB)[1].alias("s"),
                           (y == 1).cast("long").alias("pos"), (y == 0).cast("long").alias("neg"))
    else:
        others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: j != y)
        as_pos = F.transform(others, lambda b: F.struct(y.alias("a"), b.alias("b"), F.element_at(F.col(PROB), y + 1).alias("s"),
                                                        F.lit(1).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg")))
        as_neg = F.transform(others, lambda a: F.struct(a.alias("a"), y.alias("b"), F.element_at(F.col(PROB), a + 1).alias("s"),
                                                        F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("neg")))
        rows = pred.select(F.explode(F.concat(as_pos, as_neg)).alias("r")).select("r.*")
    return rows.groupBy("a", "b", "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def auc_ovo(pred: DataFrame, k: int) -> DataFrame:
    """One-vs-one AUC (Hand & Till), tie-averaged; binary -> plain AUC of class 1."""
    agg = _pair_scores(pred, k)
    cum = cumulative_below(agg, ["a", "b"], "s", ["neg"])
    contrib = cum.groupBy("a", "b").agg(
        F.sum(F.col("pos") * (F.col("below_neg") + 0.5 * F.col("neg"))).alias("u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pair_auc = contrib.select("a", "b", (F.col("u") / (F.col("P") * F.col("N"))).alias("auc"))
    if k <= 2:
        return pair_auc.select(F.col("auc"))
    sym = pair_auc.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "auc") \
        .groupBy("i", "j").agg(F.avg("auc").alias("auc"))
    return sym.agg(F.avg("auc").alias("auc"))


def average_precision(pred: DataFrame, k: int) -> DataFrame:
    """One-vs-rest average precision per class, then micro / macro / weighted.

    Every (row, class) pair is exploded once and counted both for its class and for the
    pooled micro curve (class -1)."""
    classes = list(range(k)) if k > 2 else [1]
    y = F.col(LABEL).cast("int")
    cells = F.transform(F.array(*[F.lit(c) for c in classes]),
                        lambda c: F.struct(c.alias("c"), (-F.element_at(F.col(PROB), c + 1)).alias("s"),
                                           (c == y).cast("long").alias("pos"), (c != y).cast("long").alias("neg")))
    ex = pred.select(F.explode(cells).alias("r")).select("r.*")
    both = ex if k <= 2 else ex.select(F.explode(F.array(F.col("c"), F.lit(-1))).alias("c"), "s", "pos", "neg")
    agg = both.groupBy("c", "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cum = cumulative_below(agg, ["c"], "s", ["pos", "neg"])  # s = -score: "below" = strictly higher score
    tp = F.col("below_pos") + F.col("pos")
    fp = F.col("below_neg") + F.col("neg")
    per = cum.groupBy("c").agg(F.sum(F.col("pos") * tp / (tp + fp)).alias("num"), F.sum("pos").alias("P"))
    ap = per.select("c", F.when(F.col("P") > 0, F.col("num") / F.col("P")).otherwise(0.0).alias("ap"), "P")
    micro = F.max(F.when(F.col("c") == -1, F.col("ap")))
    if k <= 2:
        micro = F.max(F.when(F.col("c") == 1, F.col("ap")))
    return ap.agg(
        micro.alias("average_precision_micro"),
        F.avg(F.when(F.col("c") >= 0, F.col("ap"))).alias("average_precision_macro"),
        (F.sum(F.when(F.col("c") >= 0, F.col("ap") * F.col("P"))) /
         F.sum(F.when(F.col("c") >= 0, F.col("P")))).alias("average_precision_weighted"))


METRICS = ["accuracy", "balanced_accuracy", "balanced_accuracy_adjusted", "f1_micro", "f1_macro", "f1_weighted",
           "recall_micro", "recall_macro", "recall_weighted", "precision_micro", "precision_macro",
           "precision_weighted", "mcc", "average_precision_micro", "average_precision_macro",
           "average_precision_weighted", "auc"]


def confusion_counts(pred: DataFrame, k: int):
    """The k x k confusion table as a numpy array: one grouped job, at most k*k rows returned."""
    import numpy as np
    cm = np.zeros((k, k))
    for r in pred.groupBy(LABEL, PRED).agg(F.count(F.lit(1)).alias("n")).collect():
        if r[LABEL] is not None and r[PRED] is not None:
            cm[int(r[LABEL]), int(r[PRED])] += r["n"]
    return cm


def metrics_from_confusion(cm) -> dict[str, float]:
    """M1-M13 from a k x k confusion table (same arithmetic as ``label_metrics``)."""
    import numpy as np
    tp, sup, npred = np.diag(cm), cm.sum(axis=1), cm.sum(axis=0)
    present = (sup > 0) | (npred > 0)
    p = np.where(npred > 0, tp / np.where(npred > 0, npred, 1), 0.0)
    r = np.where(sup > 0, tp / np.where(sup > 0, sup, 1), 0.0)
    f = np.where(p + r > 0, 2 * p * r / np.where(p + r > 0, p + r, 1), 0.0)
    n, c = cm.sum(), tp.sum()
    acc = c / n if n else float("nan")
    kt = int((sup > 0).sum())
    bal = float(r[sup > 0].mean()) if kt else float("nan")
    pm, rm, fm = (float(v[present].mean()) for v in (p, r, f))
    pw, rw, fw = (float((v * sup)[present].sum() / n) for v in (p, r, f))
    den = np.sqrt((n * n - (npred * npred).sum()) * (n * n - (sup * sup).sum()))
    mcc = float((c * n - (sup * npred).sum()) / den) if den > 0 else 0.0
    return {"accuracy": acc, "balanced_accuracy": bal,
            "balanced_accuracy_adjusted": (bal - 1.0 / kt) / (1 - 1.0 / kt) if kt > 1 else 0.0,
            "f1_micro": acc, "f1_macro": fm, "f1_weighted": fw, "recall_micro": acc, "recall_macro": rm,
            "recall_weighted": rw, "precision_micro": acc, "precision_macro": pm, "precision_weighted": pw, "mcc": mcc}


def score_value(pred: DataFrame, labels: list[str], metric: str) -> float:
    """One metric as a float (used by the spot-check driver loop): one job per call."""
    k = len(labels)
    if metric == "auc":
        return float(auc_ovo(pred, k).first()["auc"])
    if metric.startswith("average_precision"):
        return float(average_precision(pred, k).first()[metric])
    if metric == "accuracy":
        return float(pred.agg(F.avg((F.col(LABEL) == F.col(PRED)).cast("double")).alias("a")).first()["a"])
    return float(metrics_from_confusion(confusion_counts(pred, k))[metric])


def fold_scores(oof: DataFrame, labels: list[str], metric: str) -> DataFrame:
    """Per-fold accuracy-type score from out-of-fold predictions in ONE grouped job."""
    if metric != "accuracy":
        raise ValueError("fold_scores computes accuracy in one job; other metrics use score_value per fold")
    return oof.groupBy("fold").agg(F.avg((F.col(LABEL) == F.col(PRED)).cast("double")).alias("score"))
