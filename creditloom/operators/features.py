"""Row-wise features, selections and decisions: one projection each, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C


def delinquency_rate() -> Column:
    return F.col("cic_num_delinquencies") / C.floor_at("cic_account_age_months", 1.0)


def dual_leverage() -> Column:
    return F.col("cic_outstanding_balance_ratio") * F.col("cic_credit_utilization")


def inquiry_ratio() -> Column:
    return F.col("cic_num_inquiries_6m") / C.floor_at("cic_num_active_accounts", 1.0)


def txn_momentum() -> Column:
    usual = F.col("txn_frequency_90d") / 3.0
    return (F.col("txn_frequency_30d") - usual) / C.floor_at(usual, 1.0)


def txn_amount_momentum() -> Column:
    long_run = F.col("avg_txn_amount_90d")
    return (F.col("avg_txn_amount_30d") - long_run) / C.floor_at(long_run, 1.0)


def financial_health(engagement_max: float = 100.0) -> Column:
    return (
        F.col("digital_payment_regularity") * 0.40
        + F.col("salary_credit_regularity") * 0.35
        + F.col("mobile_app_engagement_score") / engagement_max * 0.25
    )


def spending_stability() -> Column:
    return F.lit(1.0) / (F.col("spending_volatility_90d") + 1.0)


def txn_density() -> Column:
    return F.col("txn_frequency_90d") / 90.0


def freq_ratio() -> Column:
    return F.col("txn_frequency_30d") / (F.col("txn_frequency_90d") / 3.0 + 1.0)


def interactions() -> dict[str, Column]:
    return {
        "utilization_x_regularity": F.col("cic_credit_utilization") * F.col("digital_payment_regularity"),
        "salary_x_delinquencies": F.col("salary_credit_regularity") * F.col("cic_num_delinquencies"),
    }


# The two tables below: derived column -> (inputs that must exist, expression).


def bureau_derived() -> dict[str, tuple[tuple[str, ...], Column]]:
    return {
        "cic_delinquency_rate": (("cic_num_delinquencies", "cic_account_age_months"), delinquency_rate()),
        "cic_dual_leverage": (("cic_outstanding_balance_ratio", "cic_credit_utilization"), dual_leverage()),
        "cic_inquiry_to_account_ratio": (("cic_num_inquiries_6m", "cic_num_active_accounts"), inquiry_ratio()),
    }


def behavioural_derived(engagement_max: float = 100.0) -> dict[str, tuple[tuple[str, ...], Column]]:
    return {
        "avg_txn_amount_30d_log": (("avg_txn_amount_30d",), F.log1p("avg_txn_amount_30d")),
        "avg_txn_amount_90d_log": (("avg_txn_amount_90d",), F.log1p("avg_txn_amount_90d")),
        "txn_momentum": (("txn_frequency_30d", "txn_frequency_90d"), txn_momentum()),
        "txn_amount_momentum": (("avg_txn_amount_30d", "avg_txn_amount_90d"), txn_amount_momentum()),
        "digital_financial_health_score": (
            ("digital_payment_regularity", "salary_credit_regularity", "mobile_app_engagement_score"),
            financial_health(engagement_max),
        ),
        "spending_stability_index": (("spending_volatility_90d",), spending_stability()),
        "txn_density_daily": (("txn_frequency_90d",), txn_density()),
    }


def _build(df: DataFrame, group: Sequence[str], derived: Mapping[str, tuple[tuple[str, ...], Column]], keep: Sequence[str]) -> DataFrame:
    base = [c for c in group if c in df.columns]
    new = [expr.alias(name) for name, (needs, expr) in derived.items() if set(needs) <= set(base)]
    return df.select(*[c for c in keep if c in df.columns], *base, *new)


def build_bureau(df: DataFrame, group: Sequence[str] = S.BUREAU, keep: Sequence[str] = (S.ID, S.TARGET)) -> DataFrame:
    """Bureau columns that exist plus the derived ones whose inputs exist."""
    return _build(df, group, bureau_derived(), keep)


def build_behavioural(df: DataFrame, group: Sequence[str] = S.BEHAVIOURAL, keep: Sequence[str] = (S.ID, S.TARGET)) -> DataFrame:
    return _build(df, group, behavioural_derived(), keep)


def select_features(df: DataFrame, features: Iterable[str] | None = None, label: str = S.TARGET, key: str = S.ID) -> DataFrame:
    """Id, label and the given features, or all other columns."""
    chosen = list(features) if features is not None else [c for c in df.columns if c not in (label, key)]
    return df.select(key, label, *chosen)


def group_columns(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in group if c in df.columns])


def drop_excluded(df: DataFrame, columns: Sequence[str] = S.EXCLUDED) -> DataFrame:
    return df.drop(*columns)


def predict_label(pd: str | Column, threshold: float = 0.5) -> Column:
    return (C.col(pd) >= F.lit(threshold)).cast("int")


def review_band(pd: str | Column, lo: float = 0.25, hi: float = 0.45) -> Column:
    p = C.col(pd)
    return F.when(p.between(lo, hi), "review").when(p < lo, "approve").when(p > hi, "decline")


def fallback_pd(behavioural: Sequence[str], pd_full: str, pd_base: str) -> Column:
    """The bureau-only probability where no behavioural value exists."""
    nothing = F.lit(True)
    for c in behavioural:
        nothing = nothing & F.col(c).isNull()
    return F.when(nothing, F.col(pd_base)).otherwise(F.col(pd_full))


def population_filter(
    df: DataFrame, activity: DataFrame, npl: DataFrame, customer: str = "customer_id",
    age: tuple[float, float] = (18, 35), max_history_months: float = 24, min_active_days: int = 30,
    demographics: Sequence[str] = S.CLEANER_DEMOGRAPHIC,
    age_col: str = "age_at_application", history: str = "cic_account_age_months",
    ts: str = "ts", activity_key: str = "customer_id", date: str | None = "application_date",
) -> DataFrame:
    """In-scope applicants.

    The activity log collapses to one first/last pair per customer before it
    meets the applications; the non-performing list is an anti-join on
    distinct keys. ``date`` bounds the activity to what precedes the
    application; None uses the whole span of the log.
    """
    span = activity.groupBy(F.col(activity_key).alias("_k")).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    until = F.col(date) if date else F.col("_last")
    active = (F.col(customer) == F.col("_k")) & (F.datediff(until, "_first") >= min_active_days)
    complete = F.lit(True)
    for c in demographics:
        complete = complete & F.col(c).isNotNull()
    in_scope = df.where(
        F.col(age_col).between(*age)
        & (F.col(history).isNull() | (F.col(history) < max_history_months))
        & complete
    )
    bad = npl.select(F.col(npl.columns[0]).alias(customer)).distinct()
    return in_scope.join(span, active, "left_semi").join(bad, customer, "left_anti")


def with_segments(df: DataFrame, tests: Mapping[str, Column], out: str = "segment") -> DataFrame:
    """One row per matched segment; segments may overlap."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return df.select("*", F.explode(names).alias(out))


def segment_tests(history: str = "cic_account_age_months", thin_months: float = 12) -> dict[str, Column]:
    none = F.col(history).isNull()
    return {"all": F.lit(True), "no_bureau": none, "thin_file": none | (F.col(history) < thin_months)}
