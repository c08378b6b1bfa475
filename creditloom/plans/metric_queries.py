"""Discrimination metrics and their curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.operators import features as X
from creditloom.operators import metrics as M
from creditloom.operators import splits as P
from creditloom.plans.catalog import query
from creditloom.plans.sqltext import AUC, BRIER, KS, LOGLOSS, SCORES, SPLIT, cells
from creditloom.sources.testbed import long_scores, scores

CELLS = SCORES + cells()
_EV = CELLS + f", ev AS (SELECT model, {AUC} AS auc, 2 * ({AUC}) - 1 AS gini, {KS} AS ks, {BRIER} AS bs, {LOGLOSS} AS ll FROM rt GROUP BY model)"


def _r(df, places=8):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("auc", _EV + "SELECT model, round(auc, 8) AS auc FROM ev")
def auc(spark, sf):
    return _r(M.evaluate(long_scores(spark, sf)).select("model", "auc"))


@query("gini", _EV + "SELECT model, round(gini, 8) AS gini FROM ev")
def gini(spark, sf):
    return _r(M.evaluate(long_scores(spark, sf)).select("model", "gini"))


@query("ks_statistic", _EV + "SELECT model, round(ks, 8) AS ks_statistic FROM ev")
def ks_statistic(spark, sf):
    return _r(M.evaluate(long_scores(spark, sf)).select("model", "ks_statistic"))


@query("brier", SCORES + "SELECT model, round(avg((score - label) * (score - label)), 8) AS brier_score FROM long_scores GROUP BY model")
def brier(spark, sf):
    return _r(M.point_losses(long_scores(spark, sf)).select("model", "brier_score"))


@query(
    "log_loss",
    SCORES + """
, c AS (SELECT model, label, greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, score)) AS p FROM long_scores)
SELECT model, round(avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END), 8) AS log_loss FROM c GROUP BY model
""",
)
def log_loss(spark, sf):
    return _r(M.point_losses(long_scores(spark, sf)).select("model", "log_loss"))


_POINT = "round_even(auc, 4) AS auc, round_even(gini, 4) AS gini, round_even(ks, 4) AS ks_statistic, round_even(bs, 4) AS brier_score, round_even(ll, 4) AS log_loss"


@query("evaluate_model", _EV + f"SELECT model, {_POINT} FROM ev WHERE model = 'full'")
def evaluate_model(spark, sf):
    return M.evaluate_model(long_scores(spark, sf).where("model = 'full'"))


@query("compare_models", _EV + f"SELECT model, {_POINT} FROM ev")
def compare_models(spark, sf):
    return M.compare_models([M.evaluate_model(long_scores(spark, sf))])


@query(
    "roc_points",
    _EV + """
, pts AS (SELECT model, score AS threshold, fpr, tpr FROM rt UNION ALL SELECT model, 'Infinity'::DOUBLE, 0e0, 0e0 FROM ev)
SELECT pts.model, threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr, round(auc, 8) AS auc, round(gini, 8) AS gini FROM pts JOIN ev ON pts.model = ev.model
""",
)
def roc_points(spark, sf):
    out = M.roc_points(long_scores(spark, sf))
    return out.select("model", "threshold", *[F.round(c, 8).alias(c) for c in ("fpr", "tpr", "auc", "gini")])


@query(
    "ks_curve",
    CELLS + """
, g AS (SELECT model, score, round(tpr - fpr, 12) AS gap FROM rt)
, b AS (SELECT model, gap, score AS t FROM g QUALIFY row_number() OVER (PARTITION BY model ORDER BY gap DESC, score DESC) = 1)
SELECT cu.model, score, round((pb + pos) / P::DOUBLE, 8) AS cdf_default, round((nb + neg) / N::DOUBLE, 8) AS cdf_non_default,
       round(greatest(gap, 0), 8) AS ks, CASE WHEN gap > 0 THEN t ELSE 'Infinity'::DOUBLE END AS ks_threshold
FROM cu JOIN b ON cu.model = b.model
""",
)
def ks_curve(spark, sf):
    out = M.ks_curve(long_scores(spark, sf))
    return out.select("model", "score", "ks_threshold", *[F.round(c, 8).alias(c) for c in ("cdf_default", "cdf_non_default", "ks")])


@query("pr_points", CELLS + "SELECT model, score AS threshold, round(tp / (tp + fp)::DOUBLE, 8) AS precision, round(tpr, 8) AS recall FROM rt")
def pr_points(spark, sf):
    return _r(M.pr_points(long_scores(spark, sf)))


@query("average_precision", CELLS + "SELECT model, round(sum(pos / P::DOUBLE * (tp / (tp + fp)::DOUBLE)), 8) AS average_precision FROM rt GROUP BY model")
def average_precision(spark, sf):
    return _r(M.average_precision(long_scores(spark, sf)))


@query("cutoff_table", CELLS + "SELECT model, score AS threshold, tp, fp, pb AS fn, nb AS tn, round(tpr - fpr, 8) AS youden FROM rt")
def cutoff_table(spark, sf):
    return _r(M.cutoff_table(long_scores(spark, sf)))


@query(
    "best_cutoff",
    CELLS + """SELECT model, score AS threshold, round(round(tpr - fpr, 12), 8) AS youden FROM rt
    QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(tpr - fpr, 12) DESC, score DESC) = 1""",
)
def best_cutoff(spark, sf):
    return _r(M.best_cutoff(M.cutoff_table(long_scores(spark, sf))))


@query(
    "confusion_counts",
    SCORES + "SELECT model, label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS n_rows FROM long_scores GROUP BY ALL",
)
def confusion_counts(spark, sf):
    return M.confusion_counts(long_scores(spark, sf))


@query(
    "score_histogram",
    SCORES + """
, e AS (SELECT model, label, min(score) AS lo, max(score) AS hi, count(*) AS n FROM long_scores GROUP BY model, label)
, b AS (SELECT s.model, s.label, least(49, floor((score - lo) / ((hi - lo) / 50e0)))::INTEGER AS bin, n, (hi - lo) / 50e0 AS w
        FROM long_scores s JOIN e ON s.model = e.model AND s.label = e.label)
SELECT model, label, bin, count(*) AS n_rows, round(count(*) / (max(n) * max(w)), 6) AS density FROM b GROUP BY model, label, bin
""",
)
def score_histogram(spark, sf):
    return _r(M.score_histogram(long_scores(spark, sf)), 6)


@query("metric_bars", _EV + "SELECT model, 'auc' AS metric, round(auc, 8) AS value FROM ev UNION ALL SELECT model, 'gini', round(gini, 8) FROM ev")
def metric_bars(spark, sf):
    return _r(M.metric_bars(M.evaluate(long_scores(spark, sf))))


@query(
    "auc_lift",
    _EV + "SELECT round(f.auc, 8) AS auc_full, round(b.auc, 8) AS auc_base, round(f.auc - b.auc, 8) AS auc_lift FROM ev f, ev b WHERE f.model = 'full' AND b.model = 'base'",
)
def auc_lift(spark, sf):
    return _r(M.auc_lift(M.evaluate(long_scores(spark, sf)), "full", "base"))


@query(
    "overfit_gap",
    SCORES + f", sp AS (SELECT *, {SPLIT} AS split FROM long_scores)" + cells("model, split", "sp") + f"""
, ev AS (SELECT model, split, {AUC} AS auc FROM rt GROUP BY model, split)
SELECT t.model, round(t.auc, 8) AS train_auc, round(v.auc, 8) AS val_auc, round(t.auc - v.auc, 8) AS auc_gap, t.auc - v.auc < 0.02 AS passed
FROM ev t JOIN ev v ON t.model = v.model WHERE t.split = 'train' AND v.split = 'val'
""",
)
def overfit_gap(spark, sf):
    return _r(M.overfit_gap(P.stratified_split(long_scores(spark, sf))))


@query(
    "segment_metrics",
    SCORES + """
, sg AS (SELECT model, 'all' AS seg, label, score FROM long_scores
         UNION ALL SELECT model, 'no_bureau', label, score FROM long_scores WHERE cic_num_active_accounts IS NULL
         UNION ALL SELECT model, 'thin_file', label, score FROM long_scores WHERE cic_num_active_accounts IS NULL OR cic_num_active_accounts < 3)
""" + cells("model, seg", "sg") + f"""
SELECT model, seg, max(P) + max(N) AS n_rows, round({AUC}, 8) AS auc, round(2 * ({AUC}) - 1, 8) AS gini FROM rt GROUP BY model, seg
""",
)
def segment_metrics(spark, sf):
    tests = X.segment_tests("cic_num_active_accounts", 3)
    df = X.with_segments(long_scores(spark, sf), tests, "seg")
    return _r(M.segment_metrics(df, by=["model", "seg"]))


@query(
    "acceptance_gate",
    _EV + """
SELECT model, round(gini, 8) AS gini, round(ks, 8) AS ks_statistic,
       CASE WHEN gini < 0.2 THEN 'Poor' WHEN gini < 0.4 THEN 'Acceptable' WHEN gini < 0.6 THEN 'Good' WHEN gini < 0.8 THEN 'Very good' ELSE 'Excellent' END AS gini_band,
       CASE WHEN ks < 0.2 THEN 'Poor' WHEN ks < 0.3 THEN 'Acceptable' WHEN ks < 0.4 THEN 'Good' ELSE 'Excellent' END AS ks_band,
       gini >= 0.4 AND ks >= 0.3 AS accepted FROM ev
""",
)
def acceptance_gate(spark, sf):
    ev = M.evaluate(long_scores(spark, sf)).select("model", "gini", "ks_statistic")
    return _r(M.acceptance_gate(ev))


_ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
_POLY = f"{_ERFC[-1]}e0"
for _k in reversed(_ERFC[:-1]):
    _POLY = f"({_k}e0 + t * {_POLY})"


@query(
    "delong_test",
    SCORES + cells("", "scores", "p_full", tag="a") + cells("", "scores", "p_base", tag="b") + f"""
, comp AS (SELECT label AS y,
             CASE WHEN label = 1 THEN (a.nb + a.neg / 2e0) / a.N ELSE (a.P - a.pb - a.pos / 2e0) / a.P END AS u,
             CASE WHEN label = 1 THEN (b.nb + b.neg / 2e0) / b.N ELSE (b.P - b.pb - b.pos / 2e0) / b.P END AS v
           FROM scores s JOIN cua a ON s.p_full = a.score JOIN cub b ON s.p_base = b.score)
, k AS (SELECT y, avg(u) AS ma, avg(v) AS mb, var_samp(u) / count(*) AS va, var_samp(v) / count(*) AS vb, covar_samp(u, v) / count(*) AS cab FROM comp GROUP BY y)
, o AS (SELECT max(ma) FILTER (y = 1) AS auc_a, max(mb) FILTER (y = 1) AS auc_b, sum(va) AS va, sum(vb) AS vb, sum(cab) AS cab FROM k)
, zz AS (SELECT *, (auc_a - auc_b) / sqrt(va + vb - 2 * cab) AS z FROM o)
, tt AS (SELECT *, abs(z) / sqrt(2e0) AS x, 1 / (1 + 0.5e0 * abs(z) / sqrt(2e0)) AS t FROM zz)
SELECT round(auc_a, 8) AS auc_a, round(auc_b, 8) AS auc_b, round(va, 10) AS var_a, round(vb, 10) AS var_b, round(cab, 10) AS cov_ab,
       round(z, 5) AS z, round(t * exp(-x * x + {_POLY}), 6) AS p_value FROM tt
""",
)
def delong_test(spark, sf):
    t = M.delong_test(scores(spark, sf), "label", "p_full", "p_base")
    places = {"var_a": 10, "var_b": 10, "cov_ab": 10, "z": 5, "p_value": 6}
    return t.select(*[F.round(c, places.get(c, 8)).alias(c) for c in t.columns])
