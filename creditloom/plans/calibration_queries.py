"""Calibration, drift, column relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions.columns import linspace
from creditloom.operators import calibration as Q
from creditloom.operators import drift as D
from creditloom.operators import relations as R
from creditloom.operators import splits as P
from creditloom.plans.catalog import query
from creditloom.plans.metric_queries import _r
from creditloom.plans.sqltext import APPS, SCORES, SPLIT, dbl, long_rows, probs
from creditloom.sources.testbed import applications, long_scores

_INNER = "[" + ", ".join(dbl(e) for e in linspace(0.0, 1.0, 10)[1:-1]) + "]"
_BINS = SCORES + f"""
, b AS (SELECT model, len(list_filter({_INNER}, lambda x: x <= score)) AS bin, label, score FROM long_scores)
, k AS (SELECT model, bin, count(*) AS n, avg(label) AS o, avg(score) AS p FROM b GROUP BY model, bin)
, t AS (SELECT model, count(*) AS n, avg(label) AS base, avg(score) AS mp, avg((score - label) * (score - label)) AS bs FROM long_scores GROUP BY model)
, s AS (SELECT t.model, any_value(bs) AS bs, any_value(mp) AS mp, any_value(base) AS base,
               sum(k.n / t.n::DOUBLE * (p - o) * (p - o)) AS rel, sum(k.n / t.n::DOUBLE * (o - base) * (o - base)) AS res,
               sum(k.n / t.n::DOUBLE * abs(o - p)) AS ece FROM k JOIN t ON k.model = t.model GROUP BY t.model)
"""


@query("brier_decomposition", _BINS + "SELECT model, round(bs, 8) AS brier_score, round(rel, 8) AS reliability, round(res, 8) AS resolution, round(base * (1 - base), 8) AS uncertainty FROM s")
def brier_decomposition(spark, sf):
    return _r(Q.brier_decomposition(long_scores(spark, sf)))


@query("brier_skill_score", _BINS + "SELECT model, round(1 - bs / (base * (1 - base)), 8) AS brier_skill_score FROM s")
def brier_skill_score(spark, sf):
    return _r(Q.brier_skill_score(long_scores(spark, sf)))


@query("ece", _BINS + "SELECT model, round(ece, 8) AS ece FROM s")
def ece(spark, sf):
    return _r(Q.expected_calibration_error(long_scores(spark, sf)))


_REPORT = """SELECT model, round_even(bs, 5) AS brier_score, round_even(rel, 5) AS reliability_error, round_even(res, 5) AS resolution,
 round_even(base * (1 - base), 5) AS uncertainty, round_even(ece, 5) AS ece, round_even(mp, 5) AS mean_predicted_pd,
 round_even(base, 5) AS observed_default_rate, round_even(mp / (base + 1e-9), 4) AS calibration_ratio FROM s"""


@query("calibration_report", _BINS + _REPORT + " WHERE model = 'full'")
def calibration_report(spark, sf):
    return Q.calibration_report(long_scores(spark, sf).where("model = 'full'"))


@query("compare_calibration", _BINS + _REPORT)
def compare_calibration(spark, sf):
    return Q.calibration_report(long_scores(spark, sf))


_CURVE = "round(avg(score), 8) AS mean_predicted_prob, round(avg(label), 8) AS fraction_of_positives, count(*) AS n_samples"


@query("reliability_table", SCORES + f"SELECT model, len(list_filter({_INNER}, lambda x: x < score)) AS bin, {_CURVE} FROM long_scores GROUP BY ALL")
def reliability_table(spark, sf):
    return _r(Q.reliability_table(long_scores(spark, sf)))


@query(
    "reliability_equal_freq",
    SCORES + f"""
, e AS (SELECT model AS m, list_sort(list_distinct(quantile_cont(score, {probs(10)}))) AS e FROM long_scores GROUP BY model)
SELECT model, len(list_filter(e[2:len(e) - 1], lambda x: x < score)) AS bin, {_CURVE} FROM long_scores JOIN e ON model = m GROUP BY ALL
""",
)
def reliability_equal_freq(spark, sf):
    df = long_scores(spark, sf)
    return _r(Q.reliability_equal_freq(df, Q.model_edges(df, ["base", "full"])))


_F = ["loan_amount_requested", "cic_account_age_months", "cic_num_delinquencies", "txn_frequency_90d", "avg_txn_amount_90d"]
_INNER_PROBS = "[" + ", ".join(dbl(p) for p in linspace(0.0, 1.0, 10)[1:-1]) + "]"


def _psi_sql(select: str) -> str:
    return APPS + f"""
, lng AS ({long_rows(_F, f"{SPLIT} AS split")})
, use AS (SELECT feature, v, split = 'test' AS act FROM lng WHERE v IS NOT NULL AND split <> 'val')
, e AS (SELECT feature AS f, quantile_cont(v, {_INNER_PROBS}) AS e FROM use WHERE NOT act GROUP BY feature)
, b AS (SELECT feature, act, len(list_filter(e, lambda x: x <= v)) AS bin FROM use JOIN e ON feature = f)
, c AS (SELECT feature, bin, count(*) FILTER (NOT act) AS ne, count(*) FILTER (act) AS na FROM b GROUP BY ALL)
, s AS (SELECT feature, ne / sum(ne) OVER w + 1e-6 AS e, na / sum(na) OVER w + 1e-6 AS a FROM c WINDOW w AS (PARTITION BY feature))
, p AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM s GROUP BY feature)
""" + select


@query("psi", _psi_sql("SELECT round(psi, 8) AS psi FROM p WHERE feature = 'loan_amount_requested'"))
def psi(spark, sf):
    df = P.stratified_split(applications(spark, sf))
    return _r(D.psi(df.where("split = 'train'"), df.where("split = 'test'"), "loan_amount_requested"))


@query("psi_per_feature", _psi_sql("SELECT feature, round(psi, 8) AS psi, psi < 0.10 AS stable FROM p"))
def psi_per_feature(spark, sf):
    df = P.stratified_split(applications(spark, sf)).where("split <> 'val'")
    cuts = D.reference_edges(df.where("split = 'train'"), _F)
    out = D.psi_per_feature(df, _F, F.col("split") == "test", cuts)
    return _r(out.withColumn("stable", F.col("psi") < 0.10))


@query(
    "psi_monthly",
    SCORES + f"""
, sc AS (SELECT application_date, segment, p_full FROM scores)
, e AS (SELECT quantile_cont(p_full, {_INNER_PROBS}) AS e FROM sc WHERE application_date < TIMESTAMP '1997-01-01')
, b AS (SELECT strftime(application_date, '%Y-%m') AS month, segment, application_date < TIMESTAMP '1997-01-01' AS ref,
               len(list_filter(e, lambda x: x <= p_full)) AS bin FROM sc, e)
, r AS (SELECT bin, count(*) / (SELECT count(*) FROM b WHERE ref)::DOUBLE AS e FROM b WHERE ref GROUP BY bin)
, bins AS (SELECT range AS bin FROM range(10))
, g AS (SELECT month, segment, count(*) AS n FROM b GROUP BY month, segment)
, x AS (SELECT g.month, g.segment, g.n, bins.bin, coalesce(r.e, 0) + 1e-6 AS e,
               coalesce((SELECT count(*) FROM b WHERE b.month = g.month AND b.segment = g.segment AND b.bin = bins.bin), 0) / g.n::DOUBLE + 1e-6 AS a
        FROM g CROSS JOIN bins LEFT JOIN r ON r.bin = bins.bin)
, p AS (SELECT month, segment, any_value(n) AS n_rows, sum((a - e) * ln(a / e)) AS psi FROM x GROUP BY month, segment)
SELECT month, segment, n_rows, round(psi, 8) AS psi, CASE WHEN psi < 0.1 THEN 'negligible' WHEN psi < 0.2 THEN 'moderate' ELSE 'significant' END AS band FROM p
""",
)
def psi_monthly(spark, sf):
    from creditloom.sources.testbed import scores

    month = F.date_format("application_date", "yyyy-MM").alias("month")
    early = F.col("application_date") < F.lit("1997-01-01").cast("timestamp_ntz")
    return _r(D.psi_by_period(scores(spark, sf), "p_full", early, [month, "segment"]))


_PSI_STATE_FEATURES = ["loan_amount_requested", "cic_num_active_accounts", "age_at_application"]


@query(
    "psi_from_state",
    APPS + f"""
, lng AS ({long_rows(_PSI_STATE_FEATURES, "application_date AS dt")})
, use AS (SELECT feature, v, strftime(dt, '%Y-%m') AS month, dt < TIMESTAMP '1997-01-01' AS ref FROM lng WHERE v IS NOT NULL)
, e AS (SELECT feature AS f, list_sort(list_distinct(quantile_cont(v, {_INNER_PROBS}))) AS e FROM use WHERE ref GROUP BY feature)
, b AS (SELECT feature, month, ref, len(list_filter(e, lambda x: x <= v)) AS bin FROM use JOIN e ON feature = f)
, bins AS (SELECT f, unnest(range(len(e) + 1)) AS bin FROM e)
, r AS (SELECT bins.f, bins.bin, count(b.bin) AS n FROM bins LEFT JOIN b ON b.feature = f AND b.bin = bins.bin AND b.ref GROUP BY ALL)
, rs AS (SELECT f, bin, n / sum(n) OVER (PARTITION BY f) + 1e-6 AS e FROM r)
, g AS (SELECT month, feature, count(*) AS n FROM b WHERE NOT ref GROUP BY ALL)
, c AS (SELECT month, feature, bin, count(*) AS k FROM b WHERE NOT ref GROUP BY ALL)
, p AS (SELECT g.month, g.feature, any_value(g.n) AS n_rows, sum((coalesce(k, 0) / g.n::DOUBLE + 1e-6 - e) * ln((coalesce(k, 0) / g.n::DOUBLE + 1e-6) / e)) AS psi
        FROM g JOIN rs ON rs.f = g.feature LEFT JOIN c ON c.month = g.month AND c.feature = g.feature AND c.bin = rs.bin GROUP BY g.month, g.feature)
SELECT month, feature, n_rows, round(psi, 8) AS psi, CASE WHEN psi < 0.1 THEN 'negligible' WHEN psi < 0.2 THEN 'moderate' ELSE 'significant' END AS band FROM p
""",
)
def psi_from_state(spark, sf):
    """Monthly stability from the saved reference and from counts that were added up in two runs."""
    from creditloom.sources.tables import stage

    df = applications(spark, sf)
    at = F.col("application_date")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    state = stage(D.reference_state(df.where(at < day("1997-01-01")), _PSI_STATE_FEATURES), "psi-reference")
    month = F.date_format("application_date", "yyyy-MM").alias("month")
    runs = [df.where((at >= day("1997-01-01")) & (at < day("1997-06-15"))), df.where(at >= day("1997-06-15"))]
    counts = D.add_counts(*[stage(D.period_counts(rows, state, [month]), "psi-counts") for rows in runs])
    return _r(D.psi_of_counts(counts, state))


_C = [*S.BUREAU, *S.BEHAVIOURAL, *S.CLEANER_DEMOGRAPHIC]
_PAIRS = APPS + ", pr AS (" + " UNION ALL ".join(
    f"SELECT '{_C[i]}' AS feature, '{_C[j]}' AS other, corr({_C[i]}, {_C[j]}) AS corr FROM applications" for i in range(len(_C)) for j in range(i)
) + ")"


@query("correlation_pairs", _PAIRS + "SELECT feature, other, round(corr, 8) AS corr FROM pr")
def correlation_pairs(spark, sf):
    return _r(R.correlation_pairs(applications(spark, sf), _C).drop("pos", "other_pos"))


@query("correlation_filter", _PAIRS + "SELECT DISTINCT feature FROM pr WHERE abs(corr) > 0.90")
def correlation_filter(spark, sf):
    return R.correlation_filter(R.correlation_pairs(applications(spark, sf), _C))


#: All features but one: on complete rows the spending volatility is a sum of two others here.
_V = [c for c in _C if c != "spending_volatility_90d"]
@query(
    "vif",
    "WITH RECURSIVE" + APPS.removeprefix("WITH") + f"""
, c AS MATERIALIZED (SELECT * FROM applications WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _V)})
, w AS (SELECT row_number() OVER () AS id, {', '.join(_V)} FROM c)
, x AS ({' UNION ALL '.join(f"SELECT id, {i} AS i, {c}::DOUBLE AS v FROM w" for i, c in enumerate(_V))})
, sw(k, i, j, v) AS (
  SELECT 0, a.i, b.i, CASE WHEN a.i = b.i THEN 1e0 ELSE corr(a.v, b.v) END FROM x a JOIN x b ON a.id = b.id GROUP BY a.i, b.i
  UNION ALL
  SELECT a.k + 1, a.i, a.j, CASE WHEN a.i = a.k AND a.j = a.k THEN -1e0 / p.v WHEN a.i = a.k OR a.j = a.k THEN a.v / p.v ELSE a.v - r.v * c.v / p.v END
  FROM sw a JOIN sw r ON r.i = a.i AND r.j = a.k JOIN sw c ON c.i = a.k AND c.j = a.j JOIN sw p ON p.i = a.k AND p.j = a.k
)
SELECT f.feature, round(-v, 6) AS vif
FROM sw JOIN (SELECT unnest([{', '.join(f"'{c}'" for c in _V)}]) AS feature, unnest(range({len(_V)})) AS n) f ON f.n = sw.i AND f.n = sw.j WHERE k = {len(_V)}
""",
)
def vif(spark, sf):
    """The SQL inverts the correlation matrix by sweeping one column after the other."""
    return _r(R.vif(applications(spark, sf), _V), 6)


_DF = _C


@query(
    "density_by_class",
    APPS + f"""
, lng AS (SELECT * FROM ({long_rows(_DF, "default_flag AS label")}) WHERE v IS NOT NULL)
, lim AS (SELECT feature AS f, min(v) AS lo0, max(v) AS hi0 FROM lng GROUP BY feature)
, kn AS (SELECT feature, label, least(511, floor((v - lo0) / ((hi0 - lo0) / 512e0))) AS cell, count(*) AS c, avg(v) AS m
         FROM lng JOIN lim ON feature = f GROUP BY ALL)
, st AS (SELECT feature, label, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi FROM lng GROUP BY ALL)
, gr AS (SELECT st.*, k, lo - (hi - lo) * 0.5 + k * ((hi - lo) * 2 / 99e0) AS x FROM st, range(100) g(k))
SELECT gr.feature, gr.label, k::INTEGER AS k, round(any_value(x), 6) AS x,
       round(sum(c * exp(-0.5 * ((x - m) / h) * ((x - m) / h)) / (n * h * sqrt(2 * pi()))), 8) AS density
FROM gr JOIN kn ON gr.feature = kn.feature AND gr.label = kn.label GROUP BY gr.feature, gr.label, k
""",
)
def density_by_class(spark, sf):
    out = R.density_by_class(applications(spark, sf), _DF)
    return out.select("feature", "label", "k", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))
