"""Row-wise features, selections, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators import features as X
from creditloom.plans.catalog import query
from creditloom.plans.sqltext import APPS, SCORES
from creditloom.sources.testbed import applications, scores, table

ID = "application_id"


def _floor(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(1e0, {c}) END"


# SQL of every derived column.
SQL = {
    "cic_delinquency_rate": f"cic_num_delinquencies / ({_floor('cic_account_age_months')})",
    "cic_dual_leverage": "cic_outstanding_balance_ratio * cic_credit_utilization",
    "cic_inquiry_to_account_ratio": f"cic_num_inquiries_6m / ({_floor('cic_num_active_accounts')})",
    "avg_txn_amount_30d_log": "ln(1e0 + avg_txn_amount_30d)",
    "avg_txn_amount_90d_log": "ln(1e0 + avg_txn_amount_90d)",
    "txn_momentum": "(txn_frequency_30d - txn_frequency_90d / 3e0) / greatest(1e0, txn_frequency_90d / 3e0)",
    "txn_amount_momentum": "(avg_txn_amount_30d - avg_txn_amount_90d) / greatest(1e0, avg_txn_amount_90d)",
    "digital_financial_health_score": "0.40e0 * digital_payment_regularity + 0.35e0 * salary_credit_regularity + 0.25e0 * (mobile_app_engagement_score / 100e0)",
    "spending_stability_index": "1e0 / (1e0 + spending_volatility_90d)",
    "txn_density_daily": "txn_frequency_90d / 90e0",
    "txn_freq_ratio_30_90d": "txn_frequency_30d / (txn_frequency_90d / 3e0 + 1e0)",
    "utilization_x_regularity": "cic_credit_utilization * digital_payment_regularity",
    "salary_x_delinquencies": "salary_credit_regularity * cic_num_delinquencies",
}


# Places after the point; products of short decimals need more to stay off ties.
PLACES = {"cic_dual_leverage": 10, "utilization_x_regularity": 10, "salary_x_delinquencies": 10}


def _sql(*names: str) -> str:
    return APPS + "SELECT application_id, " + ", ".join(f"round({SQL[n]}, {PLACES.get(n, 6)}) AS {n}" for n in names) + " FROM applications"


def _one(name: str, expr):
    @query(name if name not in _KEYS else _KEYS[name], _sql(name))
    def run(spark, sf):
        return applications(spark, sf).select(ID, F.round(expr(), PLACES.get(name, 6)).alias(name))

    return run


# Query names that differ from the column they produce.
_KEYS = {
    "cic_delinquency_rate": "bureau_delinquency_rate",
    "cic_dual_leverage": "bureau_dual_leverage",
    "cic_inquiry_to_account_ratio": "bureau_inquiry_ratio",
    "digital_financial_health_score": "financial_health_score",
    "spending_stability_index": "spending_stability",
    "txn_freq_ratio_30_90d": "freq_ratio_30_90",
}
_one("cic_delinquency_rate", X.delinquency_rate)
_one("cic_dual_leverage", X.dual_leverage)
_one("cic_inquiry_to_account_ratio", X.inquiry_ratio)
_one("txn_momentum", X.txn_momentum)
_one("txn_amount_momentum", X.txn_amount_momentum)
_one("digital_financial_health_score", X.financial_health)
_one("spending_stability_index", X.spending_stability)
_one("txn_density_daily", X.txn_density)
_one("txn_freq_ratio_30_90d", X.freq_ratio)


@query("amount_log", _sql("avg_txn_amount_30d_log", "avg_txn_amount_90d_log"))
def amount_log(spark, sf):
    return applications(spark, sf).select(
        ID, *[F.round(F.log1p(c), 6).alias(f"{c}_log") for c in ("avg_txn_amount_30d", "avg_txn_amount_90d")]
    )


@query("interactions", _sql("utilization_x_regularity", "salary_x_delinquencies"))
def interactions(spark, sf):
    return applications(spark, sf).select(ID, *[F.round(e, 10).alias(n) for n, e in X.interactions().items()])


def _rounded(df):
    return df.select(*[F.round(c, PLACES.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _built(group, derived) -> str:
    cols = [f"round({c}, 6) AS {c}" for c in group] + [f"round({SQL[c]}, {PLACES.get(c, 6)}) AS {c}" for c in derived]
    return APPS + "SELECT application_id, default_flag, " + ", ".join(cols) + " FROM applications"


@query("build_bureau_features", _built(S.BUREAU, ["cic_delinquency_rate", "cic_dual_leverage", "cic_inquiry_to_account_ratio"]))
def build_bureau_features(spark, sf):
    return _rounded(X.build_bureau(applications(spark, sf)))


@query(
    "build_behavioral_features",
    _built(S.BEHAVIOURAL, [
        "avg_txn_amount_30d_log", "avg_txn_amount_90d_log", "txn_momentum", "txn_amount_momentum",
        "digital_financial_health_score", "spending_stability_index", "txn_density_daily",
    ]),
)
def build_behavioral_features(spark, sf):
    return _rounded(X.build_behavioural(applications(spark, sf)))


@query("select_features", APPS + "SELECT application_id, default_flag, cic_num_delinquencies, age_at_application FROM applications")
def select_features(spark, sf):
    return X.select_features(applications(spark, sf), ["cic_num_delinquencies", "age_at_application"])


@query("group_columns", APPS + "SELECT age_at_application, declared_income_bracket, education_level, count(*) AS n_rows FROM applications GROUP BY ALL")
def group_columns(spark, sf):
    got = X.group_columns(applications(spark, sf), ["age_at_application", "declared_income_bracket", "education_level", "absent_column"])
    return got.groupBy(*got.columns).agg(F.count(F.lit(1)).alias("n_rows"))


@query("excluded_columns", APPS + "SELECT customer_id, segment, employment_type, default_flag, count(*) AS n_rows FROM applications GROUP BY ALL")
def excluded_columns(spark, sf):
    left = X.drop_excluded(applications(spark, sf))
    keys = [c for c in left.columns if c not in S.BUREAU + S.BEHAVIOURAL + S.CLEANER_DEMOGRAPHIC]
    return left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


@query("predict_label", SCORES + "SELECT application_id, p_full, CASE WHEN p_full >= 0.5 THEN 1 ELSE 0 END AS predicted FROM scores")
def predict_label(spark, sf):
    return scores(spark, sf).select(ID, "p_full", X.predict_label("p_full").alias("predicted"))


@query(
    "review_band",
    SCORES + "SELECT application_id, CASE WHEN p_full BETWEEN 0.25 AND 0.45 THEN 'review' WHEN p_full < 0.25 THEN 'approve' ELSE 'decline' END AS route FROM scores",
)
def review_band(spark, sf):
    return scores(spark, sf).select(ID, X.review_band("p_full").alias("route"))


@query(
    "credit_score",
    SCORES + """
, s AS (SELECT application_id, least(1 - 1e-6, greatest(1e-6, p_full)) AS p FROM scores)
SELECT application_id, trunc(least(850e0, greatest(300e0,
       (600e0 - 20e0 / ln(2e0) * ln(50e0)) - 20e0 / ln(2e0) * ln(p / (1e0 - p)))))::INTEGER AS credit_score FROM s
""",
)
def credit_score(spark, sf):
    return scores(spark, sf).select(ID, C.credit_score("p_full").alias("credit_score"))


_NO_BEHAVIOUR = " AND ".join(f"{c} IS NULL" for c in S.BEHAVIOURAL)
#: The derived applications know most behavioural values of everybody: no salary and no spread means no digital footprint.
_FOOTPRINT = "spending_volatility_90d IS NOT NULL OR salary_credit_regularity > 0"


@query(
    "bureau_only_fallback",
    SCORES + f"""
, b AS (SELECT application_id, {", ".join(f"CASE WHEN {_FOOTPRINT} THEN {c} END AS {c}" for c in S.BEHAVIOURAL)} FROM applications)
SELECT s.application_id, CASE WHEN {_NO_BEHAVIOUR} THEN p_base ELSE p_full END AS pd
FROM scores s JOIN b ON s.application_id = b.application_id
""",
)
def bureau_only_fallback(spark, sf):
    """All ten behavioural columns decide; they and both scores come from one projection."""
    known = scores(spark, sf, keep=S.BEHAVIOURAL)
    known = known.withColumns({c: F.when(F.expr(_FOOTPRINT), F.col(c)) for c in S.BEHAVIOURAL})
    return known.select(ID, X.fallback_pd(S.BEHAVIOURAL, "p_full", "p_base").alias("pd"))


#: Events start in 2024, applications in 1995: shifted back by so many days they overlap.
_SHIFT = 10_000


@query(
    "population_filter",
    APPS + f"""
, act AS (SELECT user_id, min(ts) - INTERVAL {_SHIFT} DAY AS f FROM events GROUP BY user_id)
SELECT application_id, a.customer_id FROM applications a JOIN act ON a.customer_id = act.user_id
WHERE age_at_application BETWEEN 18 AND 35 AND (cic_account_age_months IS NULL OR cic_account_age_months < 24)
  AND age_at_application IS NOT NULL AND declared_income_bracket IS NOT NULL AND education_level IS NOT NULL
  AND date_diff('day', f::DATE, a.application_date::DATE) >= 30
  AND a.customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""",
)
def population_filter(spark, sf):
    npl = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    events = table(spark, sf, "events").select("user_id", (F.col("ts") - F.expr(f"INTERVAL {_SHIFT} DAYS")).alias("ts"))
    return X.population_filter(applications(spark, sf), events, npl, activity_key="user_id").select(ID, "customer_id")


@query(
    "active_npl_exclusion",
    APPS + "SELECT application_id FROM applications WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def active_npl_exclusion(spark, sf):
    npl = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("customer_id"))
    return applications(spark, sf).join(npl, "customer_id", "left_anti").select(ID)


@query(
    "segment_predicates",
    APPS + """
SELECT 'all' AS seg, count(*) AS n_rows FROM applications
UNION ALL SELECT 'no_bureau', count(*) FROM applications WHERE cic_account_age_months IS NULL
UNION ALL SELECT 'thin_file', count(*) FROM applications WHERE cic_account_age_months IS NULL OR cic_account_age_months < 60
""",
)
def segment_predicates(spark, sf):
    out = X.with_segments(applications(spark, sf), X.segment_tests(thin_months=60), "seg")
    return out.groupBy("seg").agg(F.count(F.lit(1)).alias("n_rows"))
