import datetime as dt

import pytest
from pyspark.sql import functions as F

from creditloom.operators import windows as W

T0 = dt.datetime(2020, 6, 30)


def _log(spark, rows):
    return spark.createDataFrame(
        [(k, T0 - dt.timedelta(days=d), float(a), c) for k, d, a, c in rows], "k int, ts timestamp, amount double, credit boolean"
    )


@pytest.fixture(scope="module")
def points(spark):
    return W.asof_points(spark.createDataFrame([(1, T0), (2, T0), (3, T0), (1, T0)], "k int, t timestamp"), "k", "t")


def test_window_is_closed_on_both_ends(spark, points):
    log = _log(spark, [(1, 0, 10, False), (1, 30, 20, False), (1, 31, 5, False), (1, 90, 7, False), (1, 91, 99, False), (1, -1, 99, False)])
    daily = W.daily_log(log, "k", "ts", "amount", F.col("credit"))
    r = {x["entity"]: x for x in W.behaviour(points, daily).collect()}
    assert len(r) == 3
    assert (r[1]["txn_frequency_30d"], r[1]["txn_frequency_60d"], r[1]["txn_frequency_90d"]) == (2, 3, 4)
    assert r[1]["avg_txn_amount_30d"] == 15.0
    assert r[2]["txn_frequency_90d"] == 0 and r[2]["avg_txn_amount_90d"] is None
    assert r[2]["spending_volatility_90d"] == 0.0


def test_regularity(spark, points):
    log = _log(spark, [(1, d, 1, False) for d in (0, 10, 20, 30)] + [(2, d, 1, False) for d in (0, 1, 1, 40)] + [(3, 5, 1, False)])
    r = {x["entity"]: x["digital_payment_regularity"] for x in W.behaviour(points, W.daily_log(log, "k", "ts", "amount")).collect()}
    assert r[1] == pytest.approx(1.0)
    import numpy as np

    gaps = np.array([39.0, 0.0, 1.0])
    assert r[2] == pytest.approx(max(0.0, 1 - gaps.std(ddof=1) / gaps.mean() / 2))
    assert r[3] is None


def test_salary(spark, points):
    log = _log(spark, [(1, 5, 100, True), (1, 35, 105, True), (1, 65, 98, True), (2, 5, 100, True), (2, 35, 300, True), (2, 65, 98, True), (3, 5, 1, True)])
    daily = W.daily_log(log, "k", "ts", "amount", F.col("credit"))
    assert {x["entity"]: x["salary_credit_regularity"] for x in W.behaviour(points, daily).collect()} == {1: 1, 2: 0, 3: 0}


def test_diversity(spark, points):
    log = _log(spark, [(1, 1, 50, False), (1, 2, 50, True), (2, 1, 5, True)]).withColumn("cat", F.col("credit").cast("string"))
    out = W.merchant_diversity(points, W.daily_log(log, "k", "ts", "amount", extra=["cat"]), "cat")
    r = {x["entity"]: (x["merchant_category_diversity"], x["merchant_entropy"]) for x in out.collect()}
    assert r[1] == (2, pytest.approx(1.0)) and r[2] == (1, 0.0) and r[3] == (0, 0.0)


def test_default_label_window(spark, points):
    perf = spark.createDataFrame(
        [(1, dt.datetime(2023, 6, 30), 90), (2, dt.datetime(2023, 7, 1), 120), (2, dt.datetime(2020, 6, 29), 120), (3, dt.datetime(2021, 1, 1), 89)],
        "k int, ts timestamp, dpd int",
    )
    out = W.default_label(points, perf, "k", "ts", "dpd")
    assert {r["entity"]: r["default_flag"] for r in out.collect()} == {1: 1, 2: 0, 3: 0}
    same_day = spark.createDataFrame([(3, T0, 91)], "k int, ts timestamp, dpd int")
    assert {r["entity"]: r["default_flag"] for r in W.default_label(points, same_day, "k", "ts", "dpd").collect()}[3] == 1


def test_sessions_cross_midnight(spark):
    t = lambda d, h, m: dt.datetime(2024, 1, d, h, m)
    rows = [(1, t(1, 23, 50), "a"), (1, t(2, 0, 5), "b"), (1, t(2, 9, 0), "a"), (2, t(5, 1, 0), "a")]
    out = W.engagement(spark.createDataFrame(rows, "u int, ts timestamp, kind string"), "u", "ts", "kind", 1800)
    r = {x["entity"]: x for x in out.collect()}
    assert (r[1]["n_sessions"], r[1]["session_seconds"], r[1]["breadth"]) == (2, 900.0, 2)
    assert r[2]["n_sessions"] == 1


def test_one_hour_of_one_entity_is_spread(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    micros = np.sort(np.concatenate([rng.integers(0, 3_600_000_000, 4000), np.full(500, 1_234_567_890)]))
    rows = spark.createDataFrame([(7, int(m), "a" if m % 2 else "b") for m in micros], "u int, m long, kind string")
    events = rows.select("u", F.timestamp_micros(F.col("m") + 1_700_000_000_000_000).alias("ts"), "kind")
    cells = W.session_cells(events, "u", "ts", 2)
    assert cells.count() > 2000 and cells.agg(F.max("n")).first()[0] < 520
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity" in plan and "second" in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len({r[0] for r in W.session_cells(events, "u", "ts", 2).select(F.spark_partition_id()).collect()}) == 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    gaps = np.diff(micros)
    r = W.engagement(events, "u", "ts", "kind", 2).first()
    assert (r["n_events"], r["n_sessions"], r["breadth"]) == (4500, 1 + int((gaps > 2_000_000).sum()), 2)
    assert r["session_seconds"] == pytest.approx(gaps[gaps <= 2_000_000].sum() / 1e6, abs=1e-9)


def test_summaries_merge_in_any_grouping(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    t = np.unique(rng.integers(0, 40_000, 300)) * 1_000_000
    parts = spark.createDataFrame([(1, int(x), int(x), 1, 0, 0) for x in t], "entity int, first long, last long, n long, breaks long, active long")
    want = None
    for width in (1, 7, 100, 5000, 40_000):
        grouped = W.merge_sessions(parts.withColumn("g", F.floor(F.col("first") / (width * 1_000_000))), ["entity", "g"], 90)
        row = tuple(W.merge_sessions(grouped, ["entity"], 90).first())
        want = want or row
        assert row == want


def test_features_read_the_log_once(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    asked = W.asof_points(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), "o_orderdate"), "k", "o_orderdate")
    daily = W.daily_log(line, "l_suppkey", "l_shipdate", "l_extendedprice", F.col("l_returnflag") == "A")
    for out in (W.behaviour(asked, daily), W.asof_window_join(asked, daily, 90, "left"), W.asof_window_join(asked, daily, 90, "inner")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_shipdate") and plan.count("Relation [l_orderkey") == 1 and "Join" not in plan


def test_hot_entity_against_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n)),
        "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 400, n), unit="D"),
        "amount": np.round(rng.gamma(2, 50, n), 2),
    })
    asof = pd.DataFrame({"k": rng.integers(0, 40, 200), "t": pd.Timestamp("2020-02-15") + pd.to_timedelta(rng.integers(0, 380, 200), unit="D")})
    asof.loc[:80, "k"] = 0
    daily = W.daily_log(spark.createDataFrame(pdf), "k", "ts", "amount")
    got = W.behaviour(W.asof_points(spark.createDataFrame(asof), "k", "t"), daily).collect()
    assert len(got) == len(asof.drop_duplicates())
    for r in got:
        t0 = pd.Timestamp(r["t0"])
        age = (t0 - pdf["ts"]).dt.days
        win = pdf[(pdf["k"] == r["entity"]) & age.between(0, 90)].assign(age=age)
        for w in (30, 60, 90):
            part = win[win["age"] <= w]
            assert r[f"txn_frequency_{w}d"] == len(part)
            if len(part):
                assert r[f"avg_txn_amount_{w}d"] == pytest.approx(part["amount"].mean())
        weekly = win.groupby(win["age"] // 7)["amount"].sum().reindex(range(13), fill_value=0.0)
        assert r["spending_volatility_90d"] == pytest.approx(weekly.std(ddof=1), abs=1e-9)
        gaps = win.sort_values("ts")["ts"].diff().dropna().dt.days
        if len(gaps) >= 2 and gaps.mean() > 0:
            want = min(1.0, max(0.0, 1 - gaps.std(ddof=1) / gaps.mean() / 2))
            assert r["digital_payment_regularity"] == pytest.approx(want, abs=1e-9)
