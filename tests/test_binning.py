import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators import binning as B


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    n = 2000
    y = (rng.random(n) < 0.18).astype(int)
    pdf = pd.DataFrame({
        "strong_feature": y * 2.0 + rng.normal(0, 1, n), "weak_feature": y * 0.3 + rng.normal(0, 1, n),
        "noise_feature": rng.normal(0, 1, n), "constant": 1.0, "default_flag": y,
    })
    return pdf, spark.createDataFrame(pdf).persist()


FEATURES = ["strong_feature", "weak_feature", "noise_feature", "constant"]


def test_iv_of_hand_counted_bins(spark):
    """A feature with the values 0 and 1 in one row each: bads 30 : 10, goods 20 : 40."""
    rows = [(0.0, 1)] * 30 + [(0.0, 0)] * 20 + [(1.0, 1)] * 10 + [(1.0, 0)] * 40
    table = B.woe_iv_table(spark.createDataFrame(rows, "x double, default_flag int"), ["x"])
    want = (30 / 40 - 20 / 60) * math.log((30 / 40) / (20 / 60)) + (10 / 40 - 40 / 60) * math.log((10 / 40) / (40 / 60))
    assert B.iv_totals(table, ["x"]).first()["iv"] == pytest.approx(want, abs=1e-6)


def test_iv_orders_features(data):
    _, df = data
    got = {r["feature"]: r["iv"] for r in B.iv_totals(B.woe_iv_table(df, FEATURES), FEATURES).collect()}
    assert got["constant"] == 0.0 and min(got.values()) >= 0
    assert got["strong_feature"] > 10 * got["weak_feature"] > 0


def test_selector(data):
    _, df = data
    sel = B.IvSelector(flag_leakage=False)
    with pytest.raises(RuntimeError):
        sel.transform(df)
    out = sel.fit_transform(df, FEATURES)
    assert "strong_feature" in out.columns and "constant" not in out.columns
    assert out.count() == df.count()
    assert sel.report().count() == len(FEATURES)


def test_leakage_warning(data):
    _, df = data
    with pytest.warns(UserWarning, match="leakage"):
        B.IvSelector().fit(df.withColumn("leak", F.col("default_flag") * 10.0 + F.rand(1)), ["leak"])


@pytest.mark.parametrize(
    "iv,label",
    [(0.0199, "Useless"), (0.02, "Weak"), (0.0999, "Weak"), (0.1, "Medium"), (0.2999, "Medium"), (0.3, "Strong"), (0.4999, "Strong"), (0.5, "Suspicious (leakage?)")],
)
def test_labels(spark, iv, label):
    assert spark.range(1).select(C.banded(F.lit(iv), S.IV_STATUS)).first()[0] == label


@pytest.mark.parametrize("ones,bins", [(20, 2), (50, 2), (5, 1), (35, 1), (49, 1)])
def test_binary_feature_bins(spark, ones, bins):
    rows = [(float(i < ones), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, default_flag int")
    assert len(B.quantile_edges(df, ["x"], 10)["x"]) - 1 == bins


def test_encoder(spark, data):
    pdf, df = data
    enc = B.WoeEncoder()
    with pytest.raises(RuntimeError):
        enc.transform(df)
    with pytest.warns(UserWarning, match="without spread"):
        enc.fit(df, FEATURES)
    coded = enc.transform(df.withColumn("application_id", F.monotonically_increasing_id()))
    assert "strong_feature_woe" in coded.columns and coded.count() == 2000
    empty = enc.transform(spark.createDataFrame([(None, 0.0)], "strong_feature double, weak_feature double"))
    assert empty.first()["strong_feature_woe"] == 0.0
    with pytest.raises(ValueError, match="both classes"):
        B.WoeEncoder().fit(df.withColumn("default_flag", F.lit(0)), ["weak_feature"])


def test_small_bins_merge(spark, data):
    _, df = data
    counts = B.bin_counts(df, B.quantile_edges(df, ["weak_feature"], 10), "default_flag")
    merged = B.merge_small_bins(counts, 350).toPandas()
    assert merged["n"].min() >= 350 and merged["n"].sum() == 2000
    enc = B.WoeEncoder(min_bin_share=0.15, iv_threshold=0.0).fit(df, ["weak_feature"])
    assert len(enc.edges["weak_feature"]) < 11
    assert min(r["n_events"] + r["n_non_events"] for r in enc.table.collect()) >= 300


def test_missing_policies(spark):
    rows = [(None if i % 4 == 0 else float(i), int(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, default_flag int")
    counts = B.bin_counts(df, B.quantile_edges(df, ["x"], 5), "default_flag")
    floor = B.evidence(counts, "floor").agg(F.sum("dist_events")).first()[0]
    additive = B.evidence(counts, "additive").agg(F.sum("dist_events")).first()[0]
    assert floor == pytest.approx(1.0) and additive < 0.8


def test_equal_width_constant(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    edges = B.equal_width_edges(df, ["x"], 4)["x"]
    assert edges[0] < 3.0 < edges[-1]
