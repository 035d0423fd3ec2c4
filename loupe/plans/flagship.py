"""The end-to-end flow (train -> evaluate -> retrain -> report -> predict), Spark-first.

``run`` is the reference's task list as plain function calls; ``flagship_predictions`` is the
small fixed configuration used by the driver's smoke check and the bench.
"""

from __future__ import annotations

import math
import time
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.operators import dark as N
from loupe.operators import evaluate as E
from loupe.operators import metrics as M
from loupe.operators.profile import drop_all_missing_columns, has_missing
from loupe.plans.prepare import Prepared, prepare
from loupe.plans.spotcheck import Candidate, FittedCandidate, Sampling, grid_search, leaderboard, spot_check
from loupe.sources import predictions as P
from loupe.sources import tables as S
from loupe.spec import SpotCheckSpec, TableSpec

DOCS_SPEC = TableSpec(id="doc_id", label="quality", text=("text",), numeric=("n_chars",),
                      categorical=("lang", "source"))


@dataclass
class RunResult:
    prepared: Prepared
    leaderboard: DataFrame | None
    best: tuple[str, str, str]
    test_predictions: DataFrame
    report: DataFrame
    confusion: DataFrame
    mispredicted: DataFrame
    dark_numbers: DataFrame
    predictions: DataFrame | None
    rate_type: str
    timings: dict = field(default_factory=dict)
    dropped_columns: list = field(default_factory=list)
    params: dict = field(default_factory=dict)
    corrections: dict | None = None
    stored: dict | None = None


def without_empty_columns(df: DataFrame, spec: SpotCheckSpec) -> tuple[DataFrame, SpotCheckSpec, list[str]]:
    """data columns without a value on any labelled row leave the table and the spec."""
    t = spec.table
    labelled = df.filter(F.col(t.label).isNotNull()).select(*t.data_columns)
    _, empty = drop_all_missing_columns(labelled)
    if empty:
        kept = lambda cols: tuple(c for c in cols if c not in empty)
        t = replace(t, text=kept(t.text), numeric=kept(t.numeric), categorical=kept(t.categorical))
        spec = replace(spec, table=t)
    return df.drop(*empty), spec, empty


def correction_factors(p: Prepared, algorithm: str, n_repeats: int = 2, flip_fraction: float = 0.2, n_splits: int = 10,
                       seed: int = 42) -> dict[str, float]:
    """N10 for every class: 1 where the table is too small to measure (N12) or nothing comes back."""
    frame = p.train().select(p.id_col, "label_idx", "features")
    found = N.correction_factors(frame, algorithm, len(p.labels), flip_fraction, n_splits, n_repeats, seed=seed, key=p.id_col)
    return {label: f if math.isfinite(f := found[i]["factor"]) else 1.0 for i, label in enumerate(p.labels)}


def run(df: DataFrame, spec: SpotCheckSpec, spot: bool = True, parallelism: int = 1, grid: list[dict] | None = None,
        corrections: bool = False, store: str | None = None, table_name: str = "table") -> RunResult:
    """The whole task: prepare, pick a candidate, fit it on the training split and on all labelled rows,
    report, and score the unlabelled rows.

    ``spot``: cross-validate all candidates of the spec instead of taking the first.  ``grid``: parameter
    sets of which the best by cross-validation is used.  ``corrections``: measure a correction factor for
    each class and apply it to the dark numbers.  ``store``: folder of the prediction-run tables that the
    scores are appended to."""
    t = {}
    t0 = time.time()
    df, spec, dropped = without_empty_columns(df, spec)
    numeric = list(spec.table.numeric)
    if numeric and has_missing(df.filter(F.col(spec.table.label).isNotNull()).select(*numeric), numeric):
        warnings.warn("training features have missing values; they count as 0", stacklevel=2)
    p = prepare(df, spec)
    k = len(p.labels)
    sampling = Sampling(spec.oversampler, spec.undersampler, spec.seed, tuple(p.converters.get("category_positions", ())) or None)
    t["prepare"] = time.time() - t0
    lb, best = None, Candidate(spec.scalers[0], spec.reductions[0], spec.algorithms[0])
    if spot and spec.train:
        t0 = time.time()
        results, b = spot_check(p, spec.scalers, spec.reductions, spec.algorithms, spec.metric, parallelism=parallelism, sampling=sampling)
        lb = leaderboard(df.sparkSession, results)
        if b is not None:
            best = b.candidate
        t["spot_check"] = time.time() - t0
    params: dict = {}
    if grid:
        t0 = time.time()
        params, _ = grid_search(p.train(), k, p.labels, best, grid, p.n_folds, spec.metric, p.id_col, sampling)
        t["grid_search"] = time.time() - t0
    t0 = time.time()
    cross = FittedCandidate(best, p.train(), k, p.id_col, sampling, **params)
    retrained = FittedCandidate(best, p.labelled(), k, p.id_col, sampling, **params)
    t["final_fit"] = time.time() - t0
    test_pred = E.with_rate(cross.transform(p.test())).persist()
    report = M.classification_report(test_pred, p.labels)
    if not cross.has_probability:
        test_pred = E.fallback_rates(test_pred, report, p.labels)
    confusion = M.confusion_long(test_pred, p.labels)
    lab = p.labelled()
    mis = E.mispredicted(cross.transform(lab), retrained.transform(lab), p.id_col, p.labels, spec.mispredicted_top)
    corrs = correction_factors(p, best.algorithm, seed=spec.seed) if corrections else None
    dark = N.dark_numbers(test_pred, p.labels, corrs)
    rate_type = E.rate_type(cross.has_probability, spec.train)
    preds, stored = None, None
    if spec.predict:
        unl = E.with_rate(retrained.transform(p.unlabelled()))
        if not retrained.has_probability:
            unl = E.fallback_rates(unl, report, p.labels)
        preds = E.prediction_results(unl, p.id_col, p.labels)
        if store:
            spark = df.sparkSession
            header = P.header_frame(spark, P.next_run_id(spark, f"{store}/header"), table_name, spec.table.data_columns, rate_type,
                                    p.labels, best.algorithm)
            stored = P.write_run(header, P.rows_frame(preds, header.first()["run_id"]), store)
    return RunResult(p, lb, (best.scaler, best.reduction, best.algorithm), test_pred, report, confusion, mis, dark, preds, rate_type, t,
                     dropped, params, corrs, stored)


def documents_spec(algorithms=("LRN",), scalers=("NOS",), reductions=("NOR",)) -> SpotCheckSpec:
    return SpotCheckSpec(table=DOCS_SPEC, algorithms=tuple(algorithms), scalers=tuple(scalers),
                         reductions=tuple(reductions))


def flagship_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores (key, class, rate, probabilities) for the unlabelled documents."""
    df = S.labelled_documents(spark, sf_dir)
    res = run(df, documents_spec(), spot=False)
    return res.predictions
