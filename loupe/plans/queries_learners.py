"""Registered rows-only queries for the learners SQL cannot sensibly express: the library-backed
and iterative classifiers (A), feature reductions (D), model-based resamplers (O, U), the
spot-check leaderboard and grid search (E2, E7) and the dark-number correction factor
(N10-N13).  They run on the whole ``embeddings`` table with the same hash split as the
SQL-checked classifiers; their goldens are the invariants in ``tests/``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loupe.operators import classifiers as A
from loupe.operators import dark as N
from loupe.operators import evaluate as E
from loupe.operators import resample as R
from loupe.operators.reduce import fit_reduction
from loupe.operators.scalers import fit_scaler
from loupe.plans.prepare import Prepared
from loupe.plans.queries_model import EMB_LABELS, emb_frame, r6
from loupe.plans.registry import query
from loupe.plans.spotcheck import grid_search, leaderboard, spot_check

K = len(EMB_LABELS)


def _scored(spark, sf, code, scaler="NOS"):
    """Fit ``code`` on the training split (after ``scaler``) and score the test split."""
    f = emb_frame(spark, sf)
    train, test = f.filter("split = 'train'"), f.filter("split = 'test'")
    if scaler != "NOS":
        s = fit_scaler(scaler, train)
        train, test = s.transform(train), s.transform(test)
    m = A.fit(code, train, K)
    p = E.with_rate(m.transform(test))
    return p.select("vec_id", "label", E.idx_to_label(EMB_LABELS, "prediction").alias("predicted"),
                    r6("rate").alias("rate"))


# (query name, algorithm code, scaler applied first).  Naive Bayes on counts needs
# non-negative inputs, so MNB/CNB see min-max scaled embeddings.
_CLASSIFIERS = [
    ("A2_logistic_regression", "LRN", "NOS"), ("A3_decision_tree", "DTC", "NOS"),
    ("A4_random_forest", "RFCL", "NOS"), ("A5_gradient_boosting", "GBC", "NOS"),
    ("A6_hist_gradient_boosting", "HIST", "NOS"), ("A7_adaboost", "ABC", "NOS"),
    ("A8_bagging", "BGC", "NOS"), ("A9_linear_svc", "LSVC", "NOS"), ("A10_svc", "SVC", "NOS"),
    ("A11_l1_selected_linear_svc", "SLSV", "NOS"), ("A12_sgd_linear", "SGDE", "NOS"),
    ("A13_ridge_classifier", "REC", "NOS"), ("A15_multinomial_nb", "MNB", "MIX"),
    ("A16_bernoulli_nb", "BNB", "NOS"), ("A17_complement_nb", "CNB", "MIX"),
    ("A19_linear_discriminant", "LDA", "NOS"), ("A20_quadratic_discriminant", "QDA", "NOS"),
    ("A22_radius_neighbours", "RADN", "NOS"), ("A23_multilayer_perceptron", "MLPC", "NOS"),
    ("A23_multilayer_perceptron_light", "MLP2", "NOS"), ("A24_balanced_random_forest", "BARF", "NOS"),
    ("A25_balanced_bagging", "BABC", "NOS"), ("A26_rusboost", "RUBC", "NOS"),
    ("A27_easy_ensemble", "EAEC", "NOS"), ("A28_hard_vote", "VOTG", "NOS"), ("A29_soft_vote", "FUTV", "NOS"),
    ("A30_stacked_forests", "SRF1", "NOS"), ("A31_stacking", "FUTS", "NOS"), ("A33_feed_forward", "PYNN", "NOS"),
]
for _name, _code, _sc in _CLASSIFIERS:
    query(_name)((lambda code, sc: (lambda spark, sf: _scored(spark, sf, code, sc)))(_code, _sc))


@query("A32_self_training")
def q_a32(spark, sf):
    """Self-training uses the rows without a class: here the test split's features, unlabelled."""
    f = emb_frame(spark, sf)
    train, test = f.filter("split = 'train'"), f.filter("split = 'test'")
    m = A.fit("STCL", train, K, unlabelled=test.drop("label_idx"))
    p = E.with_rate(m.transform(test))
    return p.select("vec_id", "label", E.idx_to_label(EMB_LABELS, "prediction").alias("predicted"), r6("rate").alias("rate"))


# ---------------------------------------------------------------- D: feature reduction
def _reduced(spark, sf, code, scaler="NOS"):
    f = emb_frame(spark, sf)
    if scaler != "NOS":
        f = fit_scaler(scaler, f.filter("split = 'train'")).transform(f)
    train = f.filter("split = 'train'")
    red = fit_reduction(code, train, K, algorithm="LRN")
    out = red.transform(f)
    return out.select("vec_id", "split", F.transform(vector_to_array(F.col("features")), lambda v: F.round(v, 6))
                      .alias("components"))


_REDUCTIONS = [("D2_recursive_feature_elimination", "RFE"), ("D3_pca", "PCA"), ("D4_truncated_svd", "TSVD"),
               ("D5_nystroem", "NYS"), ("D6_gaussian_random_projection", "GRP"), ("D7_fast_ica", "FICA"),
               ("D8_nmf", "NMF")]
for _name, _code in _REDUCTIONS:
    # NMF needs non-negative inputs: it sees min-max scaled embeddings
    query(_name)((lambda code: (lambda spark, sf: _reduced(spark, sf, code, "MIX" if code == "NMF" else "NOS")))(_code))


@query("D9_n_components_used")
def q_d9(spark, sf):
    """Components each reduction keeps when fitted on the training split."""
    train = emb_frame(spark, sf).filter("split = 'train'")
    scaled = fit_scaler("MIX", train).transform(train)
    rows = []
    for code in ("NOR", "PCA", "TSVD", "NYS", "GRP", "FICA", "NMF", "RFE"):
        red = fit_reduction(code, scaled if code == "NMF" else train, K, algorithm="LRN")
        rows.append((code, red.components))
    return spark.createDataFrame(rows, "reduction string, components int")


# ---------------------------------------------------------------- O / U: resampling of the training split
def _resampled(spark, sf, over="NOG", under="NUG"):
    train = emb_frame(spark, sf).filter("split = 'train'").select("vec_id", "label_idx", "features")
    if over in ("SNC", "SNN"):  # codes of the first components for the samplers of category columns
        code = lambda i: F.floor(vector_to_array("features")[i] * 8).cast("double")
        rest = [vector_to_array("features")[i] for i in range(2, 8)] if over == "SNC" else [code(i) for i in range(2, 6)]
        train = train.withColumn("features", array_to_vector(F.array(code(0), code(1), *rest)))
    out = R.undersample(under, R.oversample(over, train, seed=0, key="vec_id", categorical=[0, 1]), seed=0, key="vec_id")
    return out.select(E.idx_to_label(EMB_LABELS, "label_idx").alias("label"),
                      F.transform(vector_to_array(F.col("features")), lambda v: F.round(v, 6)).alias("x"))


_RESAMPLERS = [
    ("O3_smote", "SME", "NUG"), ("O4_smote_nc", "SNC", "NUG"), ("O5_smote_n", "SNN", "NUG"),
    ("O6_adasyn", "ADA", "NUG"), ("O7_borderline_smote", "BRD", "NUG"), ("O8_kmeans_smote", "KMS", "NUG"),
    ("O9_svm_smote", "SVM", "NUG"), ("U3_cluster_centroids", "NOG", "CCS"), ("U5_repeated_enn", "NOG", "RNN"),
    ("U6_all_knn", "NOG", "AKN"), ("U7_instance_hardness", "NOG", "IHT"), ("U8_near_miss", "NOG", "NMS"),
    ("U9_neighbourhood_cleaning", "NOG", "NCR"), ("U10_one_sided_selection", "NOG", "OSS"),
    ("U11_tomek_links", "NOG", "TKL"),
]
for _name, _o, _u in _RESAMPLERS:
    query(_name)((lambda o, u: (lambda spark, sf: _resampled(spark, sf, o, u)))(_o, _u))


# ---------------------------------------------------------------- E2 / E7: model selection
def _prepared(spark, sf) -> Prepared:
    return Prepared(emb_frame(spark, sf), EMB_LABELS, 5, "vec_id")


@query("E2_spot_check_leaderboard")
def q_e2(spark, sf):
    results, _ = spot_check(_prepared(spark, sf), ("NOS", "STA"), ("NOR", "PCA"), ("DUMY", "NCT", "GNB", "LDA"),
                            "accuracy", n_folds=5, parallelism=4)
    lb = leaderboard(spark, results)
    return lb.select(F.col("Preprocessor").alias("preprocessor"), F.col("`Feature Reduction`").alias("reduction"),
                     F.col("`Algorithm (Library)`").alias("algorithm"), F.col("Components").alias("components"),
                     r6(F.col("`Mean cv`")).alias("mean_cv"), r6(F.col("`Stdev.`")).alias("std_cv"),
                     r6(F.col("`Test data`")).alias("test"), F.col("Exception").alias("exception"))


@query("E7_grid_search")
def q_e7(spark, sf):
    p = _prepared(spark, sf)
    grid = [{"var_smoothing": v} for v in (1e-9, 1e-6, 1e-3, 1e-1)]
    best, score = grid_search(p.train(), K, EMB_LABELS, "GNB", grid, 5)
    return spark.createDataFrame([("GNB", str(best), float(score))], "algorithm string, best_params string, mean_cv double")


# ---------------------------------------------------------------- N10-N13: correction factor
def _factors(f, sample_size=1.0, predict_mode="predict"):
    """Flip 20 % of each class's labels; Gaussian NB of every class x split x repeat."""
    return N.correction_factors(f, "GNB", K, sample_size=sample_size, predict_mode=predict_mode, key="vec_id")


def _factor_table(spark, sf, predict_mode):
    f = emb_frame(spark, sf).select("vec_id", "label_idx", "features")
    rows = [(EMB_LABELS[c], float(r["factor"]), r["skipped"], r["n_rows"]) for c, r in _factors(f, 1.0, predict_mode).items()]
    out = spark.createDataFrame(rows, "label string, factor double, skipped boolean, n_rows long")
    return out.select("label", r6("factor").alias("factor"), "skipped", "n_rows")


@query("N10_correction_factors")
def q_n10(spark, sf):
    """The correction factor of every class, measured on the whole table: one row a class."""
    return _factor_table(spark, sf, "predict")


@query("N11_correction_factors_probability")
def q_n11(spark, sf):
    """The same by the mean probability that the flipped rows get for their class."""
    return _factor_table(spark, sf, "predict_proba")


@query("N10_N13_correction_factor")
def q_n13(spark, sf):
    """For every class, the factor per sample share and its extrapolation to the whole table."""
    f = emb_frame(spark, sf).select("vec_id", "label_idx", "features")
    found = {share: _factors(f, share) for share in (0.5, 0.75, 0.9)}
    rows = []
    for i, label in enumerate(EMB_LABELS):
        rows += [(label, f"sample_{share}", float(r[i]["factor"]), r[i]["skipped"]) for share, r in found.items()]
        points = [(share, r[i]["factor"]) for share, r in found.items() if not r[i]["skipped"]]
        rows += [(label, model, v, v is None) for model, v in N.extrapolations(points).items()]
    out = spark.createDataFrame(rows, "label string, model string, factor double, skipped boolean")
    return out.select("label", "model", r6("factor").alias("factor"), "skipped")
