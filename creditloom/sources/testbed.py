"""Application-shaped inputs derived from the supplied star-schema tables.

Every column is computed by Spark from the given rows: one order is one
application, its lines are the bureau record (absent for orders without
lines), and the ship log is the dated transaction log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.sources.tables import stage

_staged: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers and per-order line aggregates as one wide table.

    Lines are aggregated (map-side first) before they meet the orders, so the
    join moves one row per order. Averages are rounded to 8 places so that the
    order of summation cannot move a value across a bin edge.
    """
    line = table(spark, sf_dir, "lineitem")
    returned = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    bureau = line.groupBy(F.col("l_orderkey").alias("application_id")).agg(
        F.count(F.lit(1)).alias("num_lines"),
        F.sum(returned).alias("num_returns"),
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.avg("l_discount"), 8).alias("avg_discount"),
        F.round(F.avg("l_tax"), 8).alias("avg_tax"),
        F.max("l_linenumber").alias("max_line"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("application_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("application_date"),
        F.col("o_totalprice").alias("loan_amount_requested"),
        F.col("o_orderpriority").alias("employment_type"),
    )
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), "c_acctbal", F.col("c_mktsegment").alias("segment")
    )
    a, k = F.col("application_id"), F.col("customer_id")
    base = orders.join(people, "customer_id").join(bureau, "application_id", "left")
    return base.select(
        "application_id", "customer_id", "application_date", "loan_amount_requested",
        "employment_type", "segment",
        F.when(F.coalesce("num_returns", F.lit(0)) + a % 3 >= 3, 1).otherwise(0).alias("default_flag"),
        (F.lit(1.0) - F.col("num_returns") / F.col("num_lines")).alias("cic_payment_history_score"),
        (F.col("avg_discount") * 12.0).alias("cic_outstanding_balance_ratio"),
        (F.col("max_line") * 3.0).alias("cic_num_inquiries_6m"),
        F.col("sum_qty").alias("cic_account_age_months"),
        F.col("num_returns").cast("double").alias("cic_num_delinquencies"),
        (F.col("avg_tax") * 15.0 - 0.1).alias("cic_credit_utilization"),
        F.col("num_lines").cast("double").alias("cic_num_active_accounts"),
        (k % 41).cast("double").alias("txn_frequency_30d"),
        (k % 41 + a % 29).cast("double").alias("txn_frequency_60d"),
        (k % 41 + a % 29 + a % 23).cast("double").alias("txn_frequency_90d"),
        (F.col("loan_amount_requested") / 10.0).alias("avg_txn_amount_30d"),
        (F.col("loan_amount_requested") / 12.0 + F.greatest("c_acctbal", F.lit(0.0))).alias("avg_txn_amount_90d"),
        (a % 30 + 1).cast("double").alias("merchant_category_diversity"),
        ((a % 131) / 100.0 - 0.1).alias("digital_payment_regularity"),
        ((k % 101) / 10.0).alias("mobile_app_engagement_score"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("spending_volatility_90d"),
        F.when(F.col("loan_amount_requested") > 250000, 1.0).otherwise(0.0).alias("salary_credit_regularity"),
        (k % 54 + 16).cast("double").alias("age_at_application"),
        (k % 5 + 1).cast("double").alias("declared_income_bracket"),
        F.when(a % 50 != 0, a % 5 + 1).cast("double").alias("education_level"),
    )


APPLICATIONS_SQL = """
applications AS MATERIALIZED (
  SELECT o.o_orderkey AS application_id, o.o_custkey AS customer_id,
         o.o_orderdate AS application_date, o.o_totalprice AS loan_amount_requested,
         o.o_orderpriority AS employment_type, c.c_mktsegment AS segment,
         CASE WHEN coalesce(l.num_returns, 0) + o.o_orderkey % 3 >= 3 THEN 1 ELSE 0 END AS default_flag,
         1e0 - l.num_returns / l.num_lines::DOUBLE AS cic_payment_history_score,
         l.avg_discount * 12e0 AS cic_outstanding_balance_ratio,
         l.max_line * 3e0 AS cic_num_inquiries_6m,
         l.sum_qty AS cic_account_age_months,
         l.num_returns::DOUBLE AS cic_num_delinquencies,
         l.avg_tax * 15e0 - 0.1e0 AS cic_credit_utilization,
         l.num_lines::DOUBLE AS cic_num_active_accounts,
         (o.o_custkey % 41)::DOUBLE AS txn_frequency_30d,
         (o.o_custkey % 41 + o.o_orderkey % 29)::DOUBLE AS txn_frequency_60d,
         (o.o_custkey % 41 + o.o_orderkey % 29 + o.o_orderkey % 23)::DOUBLE AS txn_frequency_90d,
         o.o_totalprice / 10e0 AS avg_txn_amount_30d,
         o.o_totalprice / 12e0 + greatest(c.c_acctbal, 0e0) AS avg_txn_amount_90d,
         (o.o_orderkey % 30 + 1)::DOUBLE AS merchant_category_diversity,
         (o.o_orderkey % 131) / 100e0 - 0.1e0 AS digital_payment_regularity,
         (o.o_custkey % 101) / 10e0 AS mobile_app_engagement_score,
         CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal END AS spending_volatility_90d,
         CASE WHEN o.o_totalprice > 250000 THEN 1e0 ELSE 0e0 END AS salary_credit_regularity,
         (o.o_custkey % 54 + 16)::DOUBLE AS age_at_application,
         (o.o_custkey % 5 + 1)::DOUBLE AS declared_income_bracket,
         CASE WHEN o.o_orderkey % 50 <> 0 THEN (o.o_orderkey % 5 + 1)::DOUBLE END AS education_level
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS num_lines,
                    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS num_returns,
                    sum(l_quantity) AS sum_qty, round(avg(l_discount), 8) AS avg_discount,
                    round(avg(l_tax), 8) AS avg_tax, max(l_linenumber) AS max_line
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)
"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application table, assembled once per session and then read as a table."""
    key = (spark.sparkContext.applicationId, sf_dir, "applications")
    if key not in _staged:
        _staged[key] = stage(derive_applications(spark, sf_dir), "applications")
    return _staged[key]


def scores(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    """(application_id, label, p_base, p_full, ...): two scores per application, and columns to keep."""
    df = applications(spark, sf_dir)
    delinq = F.coalesce("cic_num_delinquencies", F.lit(0.0))
    amount = (F.col("loan_amount_requested") - 250000.0) / 100000.0
    return df.select(
        *keep, "application_id", "application_date", "segment",
        "cic_num_active_accounts", "cic_num_delinquencies",
        F.col("default_flag").alias("label"),
        F.round(1.0 / (1.0 + F.exp(-(amount * 0.5 + delinq * 0.4 - 1.0))), 3).alias("p_base"),
        F.round(1.0 / (1.0 + F.exp(-(amount * 0.1 + delinq * 1.5 - 3.0))), 4).alias("p_full"),
    )


SCORES_SQL = (
    APPLICATIONS_SQL
    + """, scores AS MATERIALIZED (
  SELECT application_id, application_date, segment, cic_num_active_accounts, cic_num_delinquencies,
         default_flag AS label,
         round(1e0 / (1e0 + exp(-((loan_amount_requested - 250000e0) / 100000e0 * 0.5e0
               + coalesce(cic_num_delinquencies, 0e0) * 0.4e0 - 1e0))), 3) AS p_base,
         round(1e0 / (1e0 + exp(-((loan_amount_requested - 250000e0) / 100000e0 * 0.1e0
               + coalesce(cic_num_delinquencies, 0e0) * 1.5e0 - 3e0))), 4) AS p_full
  FROM applications)
, long_scores AS (
  SELECT application_id, application_date, segment, cic_num_active_accounts, label,
         'base' AS model, p_base AS score FROM scores
  UNION ALL
  SELECT application_id, application_date, segment, cic_num_active_accounts, label,
         'full' AS model, p_full AS score FROM scores)
"""
)


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(…, model, score): one row per application and model."""
    df = scores(spark, sf_dir)
    keep = ["application_id", "application_date", "segment", "cic_num_active_accounts", "label"]
    return df.select(
        *keep,
        F.explode(F.array(
            F.struct(F.lit("base").alias("model"), F.col("p_base").alias("score")),
            F.struct(F.lit("full").alias("model"), F.col("p_full").alias("score")),
        )).alias("_m"),
    ).select(*keep, "_m.model", "_m.score")
