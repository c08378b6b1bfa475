"""Fixed values of the application data model: names, bounds, thresholds."""

from __future__ import annotations

# Column names of the application table.
TARGET = "default_flag"
ID = "application_id"

BUREAU = [
    "cic_payment_history_score",
    "cic_outstanding_balance_ratio",
    "cic_num_inquiries_6m",
    "cic_account_age_months",
    "cic_num_delinquencies",
    "cic_credit_utilization",
    "cic_num_active_accounts",
]
BEHAVIOURAL = [
    "txn_frequency_30d",
    "txn_frequency_60d",
    "txn_frequency_90d",
    "avg_txn_amount_30d",
    "avg_txn_amount_90d",
    "merchant_category_diversity",
    "digital_payment_regularity",
    "mobile_app_engagement_score",
    "spending_volatility_90d",
    "salary_credit_regularity",
]
DEMOGRAPHIC_ENCODED = [
    "age_at_application",
    "employment_type_encoded",
    "declared_income_bracket_encoded",
    "education_level_encoded",
]
REQUIRED = BUREAU + BEHAVIOURAL + DEMOGRAPHIC_ENCODED + [TARGET]

# The numeric columns the cleaner handles, in output order.
CLEANER_BEHAVIOURAL = [
    c for c in BEHAVIOURAL if c not in ("txn_frequency_60d", "avg_txn_amount_90d")
]
CLEANER_DEMOGRAPHIC = ["age_at_application", "declared_income_bracket", "education_level"]
CLEANER_NUMERIC = BUREAU + CLEANER_BEHAVIOURAL + CLEANER_DEMOGRAPHIC
CATEGORICAL = ["employment_type"]

# Domain bounds for clipping.
CLIP_BOUNDS = {
    "cic_outstanding_balance_ratio": (0.0, 1.0),
    "cic_credit_utilization": (0.0, 1.0),
    "digital_payment_regularity": (0.0, 1.0),
    "age_at_application": (18.0, 65.0),
    "cic_num_inquiries_6m": (0.0, 20.0),
    "txn_frequency_30d": (0.0, 500.0),
    "txn_frequency_90d": (0.0, 1500.0),
}

# Documented valid ranges (None = open end) and the highest
# documented missing rate of each column.
VALID_RANGES = {
    "cic_payment_history_score": (0.0, 1.0, 0.15),
    "cic_outstanding_balance_ratio": (0.0, 1.0, 0.15),
    "cic_num_inquiries_6m": (0.0, 20.0, 0.15),
    "cic_account_age_months": (0.0, 240.0, 0.15),
    "cic_num_delinquencies": (0.0, 50.0, 0.15),
    "cic_credit_utilization": (0.0, 1.0, 0.15),
    "cic_num_active_accounts": (0.0, 20.0, 0.15),
    "txn_frequency_30d": (0.0, 500.0, 0.05),
    "txn_frequency_90d": (0.0, 1500.0, 0.05),
    "avg_txn_amount_30d": (0.0, 50_000_000.0, 0.05),
    "merchant_category_diversity": (1.0, 50.0, 0.05),
    "digital_payment_regularity": (0.0, 1.0, 0.05),
    "mobile_app_engagement_score": (0.0, 10.0, 0.05),
    "spending_volatility_90d": (0.0, None, 0.05),
    "salary_credit_regularity": (0.0, 1.0, 0.05),
    "age_at_application": (18.0, 65.0, 0.01),
    "declared_income_bracket": (1.0, 5.0, 0.05),
    "education_level": (1.0, 5.0, 0.03),
}

# Columns that must never reach a model.
EXCLUDED = [
    "application_id",
    "application_date",
    "loan_amount_requested",
    "phone_number",
    "home_address_region",
]

# Name prefixes of the feature groups.
PREFIXES = {
    "behavioral": (
        "txn_", "avg_txn_", "merchant_", "digital_",
        "mobile_app_", "spending_", "salary_credit_",
    ),
    "bureau": ("cic_",),
    "demographic": ("age_", "employment_", "declared_", "education_"),
}

# Score scaling.
SCORE_BASE = 600.0
ODDS_BASE = 50.0
POINTS_TO_DOUBLE_ODDS = 20.0

# Thresholds and the labels they separate.
IV_STRENGTH = [(0.02, "Not predictive"), (0.10, "Weak"), (0.30, "Medium"), (None, "Strong")]
IV_STATUS = [
    (0.02, "Useless"), (0.10, "Weak"), (0.30, "Medium"),
    (0.50, "Strong"), (None, "Suspicious (leakage?)"),
]
IV_MIN = 0.02
IV_LEAKAGE = 0.50
PSI_BANDS = [(0.10, "negligible"), (0.20, "moderate"), (None, "significant")]
GINI_BANDS = [
    (0.20, "Poor"), (0.40, "Acceptable"), (0.60, "Good"),
    (0.80, "Very good"), (None, "Excellent"),
]
KS_BANDS = [(0.20, "Poor"), (0.30, "Acceptable"), (0.40, "Good"), (None, "Excellent")]
GATE = {"gini_min": 0.40, "ks_min": 0.30, "psi_max": 0.20}
DEFAULT_DPD = 90
PERFORMANCE_MONTHS = 36
SEED = 42
