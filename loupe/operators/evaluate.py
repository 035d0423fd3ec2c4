"""Scoring and reports.

Prediction frames carry the key, ``label_idx`` (truth, null when unlabelled), ``prediction``
(index) and ``probability`` (array or null).  Labels (k <= 30) map index <-> text through a
literal map, never a join against data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL, PRED, PROB, RATE = "label_idx", "prediction", "probability", "rate"


def idx_to_label(labels: list[str], col: str | Column) -> Column:
    m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(float(i)), F.lit(lab))])
    c = F.col(col) if isinstance(col, str) else col
    return m[c.cast("double")]


def label_to_idx(labels: list[str], col: str | Column) -> Column:
    m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(float(i)))])
    c = F.col(col) if isinstance(col, str) else col
    return m[c]


def with_rate(pred: DataFrame) -> DataFrame:
    """rate = largest class probability; -1 when the model has no probabilities."""
    return pred.withColumn(RATE, F.coalesce(F.array_max(F.col(PROB)), F.lit(-1.0)))


def rate_type(has_probability: bool, training: bool) -> str:
    """I = model probabilities, A = fallback from class precision while training, U = unknown."""
    if has_probability:
        return "I"
    return "A" if training else "U"


def fallback_rates(pred: DataFrame, report: DataFrame, labels: list[str]) -> DataFrame:
    """Without model probabilities the rate is the precision of the predicted class."""
    prec = report.select(F.col("class").alias("_pl"), F.col("precision").alias("_prec"))
    out = pred.withColumn("_pl", idx_to_label(labels, PRED)).join(F.broadcast(prec), "_pl", "left")
    return out.withColumn(RATE, F.when(F.col(RATE) < 0, F.coalesce(F.col("_prec"), F.lit(-1.0)))
                          .otherwise(F.col(RATE))).drop("_pl", "_prec")


def rates_summary(pred: DataFrame) -> DataFrame:
    """Mean and population std of the rates."""
    return pred.agg(F.avg(RATE).alias("mean_rate"), F.stddev_pop(RATE).alias("std_rate"))


def prediction_results(pred: DataFrame, id_col: str, labels: list[str], fmt: str | None = None) -> DataFrame:
    """Key, predicted label, rate, probabilities as CSV text (-1 per class when absent).

    ``fmt`` (e.g. '%.6f') fixes the number format of the probability text."""
    k = len(labels)
    probs = F.coalesce(F.col(PROB), F.array_repeat(F.lit(-1.0), k))
    as_text = (lambda p: p.cast("string")) if fmt is None else (lambda p: F.format_string(fmt, p))
    return pred.select(F.col(id_col).alias("unique_key"), idx_to_label(labels, PRED).alias("class_result"),
                       F.col(RATE).alias("class_rate"),
                       F.array_join(F.transform(probs, as_text), ",").alias("class_probabilities"))


def mispredicted(cross: DataFrame, retrained: DataFrame, id_col: str, labels: list[str], top: int = 50,
                 extra_cols: list[str] = ()) -> DataFrame:
    """Rows where either model is wrong; the cross-trained model takes precedence.

    Adds Actual, Predicted, Model and P(class) columns and keeps the ``top`` most confident
    mistakes (the top-k is the feature; it runs as a distributed TakeOrderedAndProject).
    """
    c = cross.select(id_col, LABEL, *extra_cols, F.col(PRED).alias("_pc"), F.col(PROB).alias("_qc"))
    r = retrained.select(id_col, F.col(PRED).alias("_pr"), F.col(PROB).alias("_qr"))
    j = c.join(r, id_col)
    wrong_c, wrong_r = F.col("_pc") != F.col(LABEL), F.col("_pr") != F.col(LABEL)
    j = j.filter(wrong_c | wrong_r)
    pred = F.when(wrong_c, F.col("_pc")).otherwise(F.col("_pr"))
    prob = F.when(wrong_c, F.col("_qc")).otherwise(F.col("_qr"))
    model = F.when(wrong_c, F.lit("cross-trained")).otherwise(F.lit("retrained"))
    j = j.select(id_col, *extra_cols, idx_to_label(labels, LABEL).alias("Actual"),
                 idx_to_label(labels, pred).alias("Predicted"), model.alias("Model"), prob.alias("_p"))
    j = j.withColumn("_rate", F.coalesce(F.array_max("_p"), F.lit(-1.0)))
    for i, lab in enumerate(labels):
        j = j.withColumn(f"P({lab})", F.coalesce(F.col("_p")[i], F.lit(-1.0)))
    return j.orderBy(F.col("_rate").desc(), F.col(id_col)).limit(top).drop("_p", "_rate")


def mispredicted_counts(pred_by_model: dict[str, DataFrame]) -> DataFrame:
    """Per model, number of wrong rows and accuracy."""
    out = None
    for name, p in pred_by_model.items():
        a = p.agg(F.count_if(F.col(PRED) != F.col(LABEL)).alias("n_wrong"),
                  F.avg((F.col(PRED) == F.col(LABEL)).cast("double")).alias("accuracy")).withColumn("model", F.lit(name))
        out = a if out is None else out.unionByName(a)
    return out
