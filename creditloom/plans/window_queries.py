"""Joins and windowed features over the dated logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.operators import windows as W
from creditloom.plans.catalog import query
from creditloom.sources.testbed import table

# Suppliers act as applicants; the first day of every active quarter is an as-of date.
_POINTS = """
pts AS (SELECT DISTINCT l_suppkey AS entity, date_trunc('quarter', l_shipdate)::DATE AS t0 FROM lineitem)
, txn AS (SELECT l_suppkey AS entity, l_shipdate::DATE AS day, l_extendedprice AS amount,
                 CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS credit, l_partkey FROM lineitem)
, win AS (SELECT p.entity, p.t0, t.day, t.amount, t.credit, t.l_partkey, date_diff('day', t.day, p.t0) AS age
          FROM pts p LEFT JOIN txn t ON p.entity = t.entity AND t.day BETWEEN p.t0 - 90 AND p.t0)
"""
_P = "WITH " + _POINTS


def _points(spark, sf):
    line = table(spark, sf, "lineitem")
    return W.asof_points(line.select("l_suppkey", F.date_trunc("quarter", "l_shipdate").alias("q")), "l_suppkey", "q")


def _daily(spark, sf):
    span = W.log_span(_points(spark, sf))
    return W.daily_log(table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice", F.col("l_returnflag") == "A", span=span)


def _behaviour(spark, sf):
    return W.behaviour(_points(spark, sf), _daily(spark, sf))


@query(
    "assemble_applications",
    """
SELECT o.o_orderkey AS application_id, o_orderpriority, b.num_lines::DOUBLE AS num_lines, round(b.sum_qty, 2) AS sum_qty, e.n_events::DOUBLE AS n_events, round(e.spend, 2) AS spend
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS num_lines, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY l_orderkey) b ON b.l_orderkey = o.o_orderkey
LEFT JOIN (SELECT user_id, count(*) AS n_events, sum(value) AS spend FROM events GROUP BY user_id) e ON e.user_id = o.o_custkey
""",
)
def assemble_applications(spark, sf):
    form = table(spark, sf, "orders").select(F.col("o_orderkey").alias(S.ID), "o_custkey", "o_orderpriority")
    bureau = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias(S.ID)).agg(
        F.count(F.lit(1)).cast("double").alias("num_lines"), F.round(F.sum("l_quantity"), 2).alias("sum_qty")
    )
    digital = table(spark, sf, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_events"), F.round(F.sum("value"), 2).alias("spend")
    )
    return W.assemble(W.assemble(form, digital, key="o_custkey"), bureau).drop("o_custkey")


@query(
    "asof_window_join",
    _P + "SELECT entity, t0::VARCHAR AS t0, day::VARCHAR AS day, age::INTEGER AS age, count(*) AS n, round(sum(amount), 2) AS amount FROM win WHERE day IS NOT NULL GROUP BY ALL",
)
def asof_window_join(spark, sf):
    rows = W.asof_window_join(_points(spark, sf), _daily(spark, sf), 90, "inner")
    return rows.select(
        "entity", F.col("t0").cast("string").alias("t0"), F.col("day").cast("string").alias("day"), "age", "n",
        F.round("amount", 2).alias("amount"),
    )


_ROLL = ", ".join(
    f"count(*) FILTER (age <= {w}) AS txn_frequency_{w}d, round(round(sum(amount) FILTER (age <= {w}), 2) / nullif(count(*) FILTER (age <= {w}), 0), 6) AS avg_txn_amount_{w}d" for w in (30, 60, 90)
)


@query("rolling_txn", _P + f"SELECT entity, t0::VARCHAR AS t0, {_ROLL} FROM win GROUP BY entity, t0")
def rolling_txn(spark, sf):
    b = _behaviour(spark, sf)
    return b.select(
        "entity", F.col("t0").cast("string").alias("t0"),
        *[F.col(f"txn_frequency_{w}d") for w in (30, 60, 90)],
        # Amounts are whole cents: fix the sum to cents, then divide.
        *[
            F.round(F.try_divide(F.round(F.col(f"avg_txn_amount_{w}d") * F.col(f"txn_frequency_{w}d"), 2), F.col(f"txn_frequency_{w}d")), 6)
            .alias(f"avg_txn_amount_{w}d") for w in (30, 60, 90)
        ],
    )


@query(
    "spending_volatility",
    _P + """
, wk AS (SELECT p.entity, p.t0, g.w, coalesce(sum(x.amount), 0e0) AS spend
         FROM pts p CROSS JOIN range(13) g(w) LEFT JOIN win x ON x.entity = p.entity AND x.t0 = p.t0 AND x.age // 7 = g.w GROUP BY ALL)
SELECT entity, t0::VARCHAR AS t0, round(stddev_samp(spend), 2) AS spending_volatility_90d FROM wk GROUP BY entity, t0
""",
)
def spending_volatility(spark, sf):
    return _behaviour(spark, sf).select(
        "entity", F.col("t0").cast("string").alias("t0"), F.round("spending_volatility_90d", 2).alias("spending_volatility_90d")
    )


@query(
    "payment_regularity",
    _P + """
, iv AS (SELECT entity, t0, date_diff('day', lag(day) OVER (PARTITION BY entity, t0 ORDER BY day), day) AS gap FROM win WHERE day IS NOT NULL)
, st AS (SELECT entity, t0, count(gap) AS m, stddev_samp(gap) AS sd, avg(gap) AS mu FROM iv GROUP BY entity, t0)
SELECT p.entity, p.t0::VARCHAR AS t0,
       CASE WHEN m >= 2 AND mu > 0 THEN round(greatest(0e0, least(1e0, 1 - sd / mu / 2)), 6) END AS digital_payment_regularity
FROM pts p LEFT JOIN st ON p.entity = st.entity AND p.t0 = st.t0
""",
)
def payment_regularity(spark, sf):
    return _behaviour(spark, sf).select(
        "entity", F.col("t0").cast("string").alias("t0"), F.round("digital_payment_regularity", 6).alias("digital_payment_regularity")
    )


@query(
    "salary_regularity",
    _P + """
, pm AS (SELECT entity, t0, least(age // 30, 2) AS period, max(credit) AS c FROM win WHERE credit IS NOT NULL GROUP BY ALL)
, md AS (SELECT *, quantile_cont(c, 0.5::DOUBLE) OVER (PARTITION BY entity, t0) AS med FROM pm)
, ok AS (SELECT entity, t0, count(*) FILTER (abs(c - med) <= 0.1e0 * med) AS k FROM md GROUP BY entity, t0)
SELECT p.entity, p.t0::VARCHAR AS t0, CASE WHEN coalesce(k, 0) >= 3 THEN 1 ELSE 0 END AS salary_credit_regularity
FROM pts p LEFT JOIN ok ON p.entity = ok.entity AND p.t0 = ok.t0
""",
)
def salary_regularity(spark, sf):
    return _behaviour(spark, sf).select("entity", F.col("t0").cast("string").alias("t0"), "salary_credit_regularity")


@query(
    "merchant_diversity",
    _P + """
, cat AS (SELECT w.entity, w.t0, p.p_type, sum(w.amount) AS x FROM win w JOIN part p ON w.l_partkey = p.p_partkey GROUP BY ALL)
, sh AS (SELECT entity, t0, x / sum(x) OVER (PARTITION BY entity, t0) AS p FROM cat)
, g AS (SELECT entity, t0, count(*) AS k, -sum(p * ln(p)) AS h FROM sh GROUP BY entity, t0)
SELECT p.entity, p.t0::VARCHAR AS t0, coalesce(k, 0) AS merchant_category_diversity,
       CASE WHEN k > 1 THEN round(h / ln(k), 6) ELSE 0e0 END AS merchant_entropy
FROM pts p LEFT JOIN g ON p.entity = g.entity AND p.t0 = g.t0
""",
)
def merchant_diversity(spark, sf):
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice")
    kinds = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    daily = W.daily_log(line.join(kinds, "l_partkey"), "l_suppkey", "l_shipdate", "l_extendedprice", extra=["p_type"], span=W.log_span(_points(spark, sf)))
    out = W.merchant_diversity(_points(spark, sf), daily, "p_type")
    return out.select(
        "entity", F.col("t0").cast("string").alias("t0"), "merchant_category_diversity", F.round("merchant_entropy", 6).alias("merchant_entropy")
    )


@query(
    "engagement_components",
    """
WITH g AS (SELECT user_id AS entity, event_type, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
, a AS (SELECT entity, count(*) AS n_events, count(*) FILTER (gap IS NULL OR gap > 21600) AS n_sessions,
               coalesce(sum(gap) FILTER (gap <= 21600), 0) AS sec, count(DISTINCT event_type) AS breadth FROM g GROUP BY entity)
SELECT entity, n_events, n_sessions, round(sec, 3) AS session_seconds, breadth, round(sec / n_sessions, 3) AS avg_session_seconds,
       round(ln(1 + n_sessions) + ln(1 + sec / n_sessions) + breadth, 6) AS engagement FROM a
""",
)
def engagement_components(spark, sf):
    out = W.engagement(table(spark, sf, "events"), "user_id", "ts", "event_type", gap_seconds=21600)
    return out.select(
        "entity", "n_events", "n_sessions", F.round("session_seconds", 3).alias("session_seconds"), "breadth",
        F.round("avg_session_seconds", 3).alias("avg_session_seconds"), F.round("engagement", 6).alias("engagement"),
    )


@query(
    "default_label",
    """
WITH late AS (SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_quantity * 2 >= 90)
SELECT o_orderkey AS application_id, CASE WHEN EXISTS (SELECT 1 FROM late l WHERE l.l_orderkey = o_orderkey
       AND l.l_shipdate >= o_orderdate AND l.l_shipdate <= o_orderdate + INTERVAL 36 MONTH) THEN 1 ELSE 0 END AS default_flag FROM orders
""",
)
def default_label(spark, sf):
    points = W.asof_points(table(spark, sf, "orders"), "o_orderkey", "o_orderdate")
    log = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", (F.col("l_quantity") * 2).alias("dpd"))
    return W.default_label(points, log, "l_orderkey", "l_shipdate", "dpd").select(F.col("entity").alias(S.ID), S.TARGET)
