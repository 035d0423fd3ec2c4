"""Spot-check: cross-validate scaler x reduction x algorithm candidates into a leaderboard
(E1-E8).

The driver loop only submits Spark jobs: every fit, transform and score is distributed.
Candidates may run concurrently from a small thread pool (Spark schedules jobs from several
threads), like ``CrossValidator(parallelism=...)``.  The modelling frame is persisted once; all
steps of a candidate, resampling and scaling included, are fitted inside each fold.
"""

from __future__ import annotations

import math
import time
import traceback
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.operators import additive as S
from loupe.operators import classifiers as A
from loupe.operators import metrics as M
from loupe.operators.reduce import fit_reduction
from loupe.operators.resample import oversample, undersample
from loupe.operators.scalers import fit_scaler
from loupe.plans.prepare import Prepared

MAX_RETRIES = 5  # fixed value: rounds tried when every candidate fails


@dataclass
class Candidate:
    scaler: str
    reduction: str
    algorithm: str


@dataclass(frozen=True)
class Sampling:
    """Over- and undersampler codes, seed, and the positions of category codes among the features."""

    over: str = "NOG"
    under: str = "NUG"
    seed: int = 42
    categorical: tuple[int, ...] | None = None


@dataclass
class Result:
    candidate: Candidate
    mean_cv: float = float("nan")
    std_cv: float = float("nan")
    test: float = float("nan")
    elapsed: float = 0.0
    components: int | None = None
    exception: str | None = None
    fold_scores: list = field(default_factory=list)


def stable(r: Result) -> bool:
    """The test score lies within two standard deviations of the mean CV score."""
    return abs(r.mean_cv - r.test) <= 2.0 * r.std_cv


def improves(r: Result, best: Result | None) -> bool:
    """A stable result replaces the best one so far if it tests better without a lower CV mean, if it
    ties or beats both with a smaller spread, or if it tests better within one standard deviation."""
    if best is None:
        return True
    cv_holds = r.mean_cv >= best.mean_cv
    return any((cv_holds and r.test > best.test,
                cv_holds and r.test >= best.test and r.std_cv < best.std_cv,
                r.test > best.test and abs(r.mean_cv - r.test) <= r.std_cv))


def pick_best(results: list[Result]) -> Result | None:
    """The best stable result, in run order; unstable ones are marked."""
    best = None
    for r in results:
        if r.exception is not None or any(math.isnan(v) for v in (r.mean_cv, r.std_cv, r.test)):
            continue
        if not stable(r):
            r.exception = f"unstable: CV {r.mean_cv:.4f} +- {r.std_cv:.4f}, test {r.test:.4f}"
        elif improves(r, best):
            best = r
    return best


def compatible(c: Candidate) -> bool:
    """E5: RFE only with algorithms that expose feature weights."""
    if c.reduction == "RFE":
        info = A.ALGORITHMS.get(c.algorithm)
        return bool(info and info.rfe_compatible)
    return True


class FittedCandidate:
    """Oversampling -> undersampling -> scaler -> reduction -> algorithm, all fitted on one frame (a fold's
    training part, or a whole split); scoring applies the fitted steps only."""

    def __init__(self, c: Candidate, train: DataFrame, k: int, key: str | None, sampling: Sampling = Sampling(), **fit_kw):
        fit_on = undersample(sampling.under, oversample(sampling.over, train, sampling.seed, key, sampling.categorical), sampling.seed, key)
        self.scaler = fit_scaler(c.scaler, fit_on)
        scaled = self.scaler.transform(fit_on)
        self.reduction = fit_reduction(c.reduction, scaled, k, algorithm=c.algorithm)
        self.components = self.reduction.components
        self.model = A.fit(c.algorithm, self.reduction.transform(scaled), k, **fit_kw)
        self.has_probability = getattr(self.model, "has_probability", True)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.reduction.transform(self.scaler.transform(df)))


def fold_sums(train: DataFrame, k: int) -> S.PartSums | None:
    """The sums of every fold, from which closed-form candidates are fitted; None for too many features."""
    dim = A.feature_dim(train)
    return S.PartSums(train, k, "fold") if dim <= S.MAX_DIM else None


def cross_val_score(train: DataFrame, k: int, labels: list[str], candidate: Candidate | str, n_folds: int, metric: str,
                    key: str | None = None, sampling: Sampling = Sampling(), sums: S.PartSums | None = None, **fit_kw) -> list[float]:
    """Every step is fitted on fold != f, fold == f is predicted and scored.  With ``sums``, a candidate without
    reduction and resampling whose learner needs only sums is fitted from them and scored in one pass."""
    c = Candidate("NOS", "NOR", candidate) if isinstance(candidate, str) else candidate
    if sums and not fit_kw and (sampling.over, sampling.under, c.reduction) == ("NOG", "NUG", "NOR") and S.supported(c.algorithm, c.scaler, sums.dim):
        oof = S.out_of_fold(sums, c.algorithm, c.scaler).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if metric == "accuracy":
                by_fold = {r["fold"]: r["score"] for r in M.fold_scores(oof, labels, metric).collect()}
                return [by_fold[f] for f in range(n_folds)]
            return [M.score_value(oof.filter(F.col("fold") == f), labels, metric) for f in range(n_folds)]
        finally:
            oof.unpersist()
    scores = []
    for f in range(n_folds):
        m = FittedCandidate(c, train.filter(F.col("fold") != f), k, key, sampling, **fit_kw)
        scores.append(M.score_value(m.transform(train.filter(F.col("fold") == f)), labels, metric))
    return scores


def _run_candidate(p: Prepared, c: Candidate, train: DataFrame, test: DataFrame, metric: str, n_folds: int,
                   sampling: Sampling, fit_kw: dict, sums: S.PartSums | None = None) -> Result:
    t0 = time.time()
    res = Result(c)
    k = len(p.labels)
    try:
        scores = cross_val_score(train, k, p.labels, c, n_folds, metric, p.id_col, sampling, sums, **fit_kw)
        res.fold_scores = scores
        res.mean_cv = sum(scores) / len(scores)
        res.std_cv = math.sqrt(sum((s - res.mean_cv) ** 2 for s in scores) / len(scores))
        model = FittedCandidate(c, train, k, p.id_col, sampling, **fit_kw)
        res.components = model.components
        res.test = M.score_value(model.transform(test), p.labels, metric)
    except Exception as e:  # E6: a failing candidate is recorded, not fatal
        res.exception = f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else traceback.format_exc(0)}"
    res.elapsed = time.time() - t0
    return res


def spot_check(p: Prepared, scalers, reductions, algorithms, metric: str = "accuracy", n_folds: int | None = None,
               parallelism: int = 1, fit_kw: dict | None = None, sampling: Sampling = Sampling()) -> tuple[list[Result], Result | None]:
    """E2 (+E4-E6): run every compatible candidate; return all results and the best stable one.  If every
    candidate fails, they are tried again, up to MAX_RETRIES rounds; the last round is returned."""
    n_folds = n_folds or p.n_folds
    train, test = p.train().persist(StorageLevel.MEMORY_AND_DISK), p.test()
    cands = [c for s in scalers for r in reductions for a in algorithms if compatible(c := Candidate(s, r, a))]
    results: list[Result] = []
    sums = None
    if any(c.reduction == "NOR" and S.supported(c.algorithm, c.scaler) for c in cands):
        sums = fold_sums(train, len(p.labels))
        if sums and any(c.algorithm == "LDA" for c in cands):
            sums.with_scatter()
    for _ in range(MAX_RETRIES):
        with ThreadPoolExecutor(max(1, parallelism)) as ex:
            results = list(ex.map(lambda c: _run_candidate(p, c, train, test, metric, n_folds, sampling, fit_kw or {}, sums), cands))
        if any(r.exception is None for r in results):
            break
    train.unpersist()
    return results, pick_best(results)


def leaderboard(spark, results: list[Result]) -> DataFrame:
    """Sorted by test desc, mean cv desc, std asc."""
    rows = [(r.candidate.scaler, r.candidate.reduction, r.candidate.algorithm, r.components,
             None if math.isnan(r.mean_cv) else r.mean_cv, None if math.isnan(r.std_cv) else r.std_cv,
             None if math.isnan(r.test) else r.test, r.elapsed, r.exception) for r in results]
    df = spark.createDataFrame(rows, "Preprocessor string, `Feature Reduction` string, `Algorithm (Library)` string, "
                                     "Components int, `Mean cv` double, `Stdev.` double, `Test data` double, "
                                     "`Elapsed Time` double, Exception string")
    return df.orderBy(F.col("`Test data`").desc_nulls_last(), F.col("`Mean cv`").desc_nulls_last(),
                      F.col("`Stdev.`").asc_nulls_last())


def grid_search(train: DataFrame, k: int, labels: list[str], algorithm: Candidate | str, grid: list[dict], n_folds: int,
                metric: str = "accuracy", key: str | None = None, sampling: Sampling = Sampling()) -> tuple[dict, float]:
    """The grid point with the best mean CV score.  A point that fails is reported as a warning; if all
    fail, that is an error, which names what each point met."""
    best, best_score, failed = {}, -math.inf, []
    for params in grid:
        try:
            scores = cross_val_score(train, k, labels, algorithm, n_folds, metric, key, sampling, **params)
        except Exception as e:  # noqa: BLE001 - reported below
            failed.append(f"{params}: {type(e).__name__}: {(str(e).splitlines() or [''])[0][:200]}")
            continue
        s = sum(scores) / len(scores)
        if s > best_score:
            best, best_score = params, s
    if grid and len(failed) == len(grid):
        raise RuntimeError("every grid point failed: " + "; ".join(failed))
    for what in failed:
        warnings.warn(f"grid point failed: {what}", stacklevel=2)
    return best, best_score
