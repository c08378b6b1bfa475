"""Attribution tables; the linear ones have fixed coefficients and SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators import attribution as A
from creditloom.operators.tree_attribution import attribution_tree as explain_trees
from creditloom.plans.catalog import query
from creditloom.plans.metric_queries import _r
from creditloom.plans.model_queries import FEATURES, cleaned, fitted
from creditloom.plans.sqltext import APPS, SPLIT
from creditloom.sources.testbed import applications

ID = "application_id"
COEF = {
    "txn_frequency_30d": 0.02, "txn_frequency_90d": -0.004, "avg_txn_amount_30d": 0.00002, "digital_payment_regularity": -0.8,
    "mobile_app_engagement_score": -0.03, "salary_credit_regularity": -0.4, "merchant_category_diversity": 0.0001,
    "age_at_application": -0.01, "declared_income_bracket": 0.05, "cic_filled": 0.6,
}
_SRC = APPS + ", src AS (SELECT *, coalesce(cic_num_delinquencies, 0e0) AS cic_filled FROM applications)"
_MEANS = ", mu AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in COEF) + " FROM src)"
_LONG = _SRC + _MEANS + ", ph AS (" + " UNION ALL ".join(
    f"SELECT application_id, '{f}' AS feature, {f} AS value, {c!r}::DOUBLE * ({f} - m_{f}) AS phi FROM src, mu" for f, c in COEF.items()
) + ")"
_IMP = _LONG + ", im AS (SELECT feature, avg(abs(phi)) AS v FROM ph GROUP BY feature)"
GROUPS = {
    "bureau": ["cic_filled"], "behavioural": [f for f in COEF if f.startswith(("txn", "avg_txn", "digital", "mobile", "salary", "merchant"))],
    "demographic": ["age_at_application", "declared_income_bracket"],
}


def _contrib(spark, sf):
    df = applications(spark, sf).withColumn("cic_filled", F.coalesce("cic_num_delinquencies", F.lit(0.0)))
    return A.attribution_linear(df, COEF)


@query("attribution_linear", _LONG + "SELECT application_id, feature, round(value, 4) AS value, round(phi, 7) AS phi FROM ph")
def attribution_linear(spark, sf):
    return A.long_form(_contrib(spark, sf)).select(ID, "feature", F.round("value", 4).alias("value"), F.round("phi", 7).alias("phi"))


@query("mean_abs_attribution", _IMP + "SELECT feature, round(v, 8) AS mean_abs_shap FROM im")
def mean_abs_attribution(spark, sf):
    return _r(A.mean_abs(_contrib(spark, sf)))


@query("prune_list", _IMP + "SELECT feature FROM im WHERE v < 0.001")
def prune_list(spark, sf):
    return A.prune_list(A.mean_abs(_contrib(spark, sf)))


@query("top_features", _IMP + "SELECT feature, round(v, 8) AS mean_abs_shap, row_number() OVER (ORDER BY v DESC, feature) AS rank FROM im ORDER BY v DESC, feature LIMIT 15")
def top_features(spark, sf):
    return _r(A.top_features(A.mean_abs(_contrib(spark, sf)), 15))


def _like(prefixes) -> str:
    return " OR ".join(f"starts_with(feature, '{p}')" for p in prefixes)


_G = {g: f"coalesce(sum(v) FILTER ({_like(p)}), 0e0)" for g, p in S.PREFIXES.items()}


@query(
    "group_attribution_prefix",
    _IMP + "SELECT " + ", ".join(f"round_even({e}, 4) AS {g}_mean_abs_shap" for g, e in _G.items())
    + ", round_even(sum(v), 4) AS total_mean_abs_shap, " + ", ".join(f"round_even({e} / sum(v) * 100, 1) AS {g}_pct" for g, e in _G.items()) + " FROM im",
)
def group_attribution_prefix(spark, sf):
    return A.group_by_prefix(A.mean_abs(_contrib(spark, sf)))


@query(
    "group_attribution_map",
    _IMP + " UNION ALL ".join(
        f"""{' ' if i else ''}SELECT '{g}' AS "group", round(coalesce(sum(v) FILTER (feature IN ({', '.join(repr(f) for f in fs)})), 0e0), 8) AS total_abs_shap,
        round_even(coalesce(sum(v) FILTER (feature IN ({', '.join(repr(f) for f in fs)})), 0e0) / sum(v) * 100, 2) AS pct_contribution FROM im"""
        for i, (g, fs) in enumerate(GROUPS.items())
    ),
)
def group_attribution_map(spark, sf):
    out = A.group_by_map(A.mean_abs(_contrib(spark, sf)), GROUPS)
    return out.withColumn("total_abs_shap", F.round("total_abs_shap", 8))


_B = "sum(v) FILTER (starts_with(feature, 'cic_'))"
_N = "sum(v) FILTER (NOT starts_with(feature, 'cic_'))"


@query("bureau_vs_rest", _IMP + f"SELECT round({_B} / ({_B} + {_N} + 1e-9) * 100, 6) AS bureau_pct, round({_N} / ({_B} + {_N} + 1e-9) * 100, 6) AS rest_pct FROM im")
def bureau_vs_rest(spark, sf):
    return _r(A.bureau_vs_rest(A.mean_abs(_contrib(spark, sf))), 6)


@query(
    "beeswarm_points",
    _IMP + """, tp AS (SELECT feature AS f FROM im ORDER BY v DESC, feature LIMIT 20)
SELECT application_id, feature, round(value, 4) AS value, round(phi, 7) AS phi FROM ph JOIN tp ON feature = f""",
)
def beeswarm_points(spark, sf):
    out = A.beeswarm_points(_contrib(spark, sf), 20)
    return out.select(ID, "feature", F.round("value", 4).alias("value"), F.round("phi", 7).alias("phi"))


_OTHERS = [f for f in COEF if f != "txn_frequency_30d"]


@query(
    "dependence_points",
    _LONG + ", co AS (" + " UNION ALL ".join(f"SELECT '{f}' AS f, abs(corr({f}, txn_frequency_30d)) AS r FROM src" for f in _OTHERS) + ")"
    + """, bs AS (SELECT f FROM co ORDER BY r DESC NULLS LAST, f LIMIT 1)
SELECT p.application_id, round(p.value, 4) AS value, round(p.phi, 7) AS phi, bs.f AS interaction, round(CASE bs.f """
    + " ".join(f"WHEN '{f}' THEN src.{f}" for f in _OTHERS)
    + """ END, 4) AS interaction_value
FROM ph p JOIN src ON p.application_id = src.application_id, bs WHERE p.feature = 'txn_frequency_30d'""",
)
def dependence_points(spark, sf):
    out = A.dependence_points(_contrib(spark, sf), "txn_frequency_30d")
    return out.select(
        ID, F.round("value", 4).alias("value"), F.round("phi", 7).alias("phi"), "interaction", F.round("interaction_value", 4).alias("interaction_value")
    )


_BASE = " + ".join(f"{c!r}::DOUBLE * m_{f}" for f, c in COEF.items())


@query(
    "waterfall_row",
    _LONG + f"SELECT application_id, feature, round(value, 4) AS value, round(phi, 7) AS phi, round({_BASE}, 6) AS base FROM ph, mu WHERE application_id = 77 ORDER BY abs(phi) DESC, feature LIMIT 15",
)
def waterfall_row(spark, sf):
    out = A.waterfall_row(_contrib(spark, sf), 77, 15)
    return out.select(ID, "feature", F.round("value", 4).alias("value"), F.round("phi", 7).alias("phi"), F.round("base", 6).alias("base"))


@query(
    "adverse_action_top3",
    _LONG + """, rk AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY phi DESC, feature) AS rank FROM ph)
SELECT application_id, rank, feature, round(phi, 7) AS phi FROM rk WHERE rank <= 3""",
)
def adverse_action_top3(spark, sf):
    return A.adverse_actions(_contrib(spark, sf)).withColumn("phi", F.round("phi", 7))


@query("attribution_tree")
def attribution_tree(spark, sf):
    """Contributions of the boosted model to every application, in log-odds."""
    model = fitted(spark, sf, "boosted").members[0][0]
    found = explain_trees(cleaned(spark, sf), model, FEATURES, values=False)
    # Rounded before the features become rows: those that no tree asks for are constants.
    return A.long_form(found.select(ID, *[C.rounded(A.phi(f), 8).alias(A.phi(f)) for f in FEATURES]), values=False)


@query("attribution_additivity", APPS + f"SELECT {SPLIT} AS split, count(*) AS n_rows, count(*) AS n_additive FROM applications GROUP BY ALL")
def attribution_additivity(spark, sf):
    """Rows whose contributions and base add up to the boosted model's own probability."""
    model, df = fitted(spark, sf, "boosted"), cleaned(spark, sf)
    parts = explain_trees(df, model.members[0][0], FEATURES, values=False)
    total = sum((F.col(A.phi(f)) for f in FEATURES), F.col("base"))
    scored = model.transform(df).select(ID, "split", "pd")
    same = F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("total"))) - F.col("pd")) < 1e-9
    return parts.select(ID, total.alias("total")).join(scored, ID).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(same.cast("long")).alias("n_additive")
    )


@query("tree_group_attribution")
def tree_group_attribution(spark, sf):
    model = fitted(spark, sf, "boosted").members[0][0]
    return A.group_by_prefix(A.mean_abs(explain_trees(cleaned(spark, sf), model, FEATURES, values=False)))
