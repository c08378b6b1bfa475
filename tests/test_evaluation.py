import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators import calibration as Q
from creditloom.operators import drift as D
from creditloom.operators import metrics as M
from creditloom.functions import columns as C


def _frame(spark, y, p, model="m"):
    return spark.createDataFrame(pd.DataFrame({"label": np.asarray(y, int), "score": np.asarray(p, float), "model": model}))


#: Score, rows and events of a model whose scores stand in four bins.
STEPS = [(0.05, 20, 2), (0.25, 10, 1), (0.55, 10, 7), (0.85, 20, 16)]


@pytest.fixture(scope="module")
def models(spark):
    score = [s for s, n, _ in STEPS for _ in range(n)]
    label = [int(k < e) for _, n, e in STEPS for k in range(n)]
    sure = _frame(spark, [1, 0, 0, 1, 0], [1.0, 0.0, 0.0, 1.0, 0.0], "sure")
    level = _frame(spark, [1, 1, 1] + [0] * 7, [0.3] * 10, "level")
    return _frame(spark, label, score, "steps").unionByName(sure).unionByName(level).persist()


#: Worked out by hand from STEPS: 60 rows, 26 events.
BY_HAND = {
    "steps": {"reliability": 0.55 / 60, "resolution": 101 / 900, "uncertainty": 26 * 34 / 3600, "brier_score": 0.1425, "ece": 5 / 60},
    "sure": {"reliability": 0.0, "resolution": 0.24, "uncertainty": 0.24, "brier_score": 0.0, "ece": 0.0},
    "level": {"reliability": 0.0, "resolution": 0.0, "uncertainty": 0.21, "brier_score": 0.21, "ece": 0.0},
}


@pytest.mark.parametrize("model", sorted(BY_HAND))
def test_brier_parts_and_ece_by_hand(models, model):
    own = models.where(F.col("model") == model)
    parts, ece = Q.brier_decomposition(own).first(), Q.expected_calibration_error(own).first()
    for name, value in BY_HAND[model].items():
        assert (ece if name == "ece" else parts)[name] == pytest.approx(value, abs=1e-9)


def test_calibration_report_by_hand(models):
    rep = {r["model"]: r for r in Q.calibration_report(models).collect()}
    assert set(rep) == set(BY_HAND)
    for model, row in rep.items():
        want = BY_HAND[model]
        assert [row[c] for c in ("brier_score", "reliability_error", "resolution", "uncertainty", "ece")] == pytest.approx(
            [round(want[c], 5) for c in ("brier_score", "reliability", "resolution", "uncertainty", "ece")], abs=1e-9
        )
    assert rep["steps"]["mean_predicted_pd"] == pytest.approx(round(26 / 60, 5), abs=1e-9) and rep["steps"]["calibration_ratio"] == pytest.approx(1.0, abs=1e-9)
    assert rep["level"]["observed_default_rate"] == pytest.approx(0.3, abs=1e-9) and rep["sure"]["calibration_ratio"] == pytest.approx(1.0, abs=1e-9)


def test_edges_left_and_right_closed(spark):
    x = [0.0, 0.3, 0.30000000000000004, 0.6, 1.0]
    df = spark.createDataFrame([(v,) for v in x], "s double")
    left = [r[0] for r in df.select(Q.uniform_bin("s")).collect()]
    right = [r[0] for r in df.select(Q.uniform_bin("s", right_closed=True)).collect()]
    edges = np.linspace(0, 1, 11)
    assert left == list(np.digitize(x, edges[1:-1]))
    assert right == list(np.searchsorted(edges[1:-1], x))


def test_all_scores_tied(spark):
    r = M.evaluate(_frame(spark, [0, 1, 1, 0], [0.4] * 4)).first()
    assert r["auc"] == 0.5 and r["ks_statistic"] == 0.0


def test_reversed_scores_have_zero_ks(spark):
    r = M.evaluate(_frame(spark, [1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9])).first()
    assert r["auc"] == 0.0 and r["gini"] == -1.0 and r["ks_statistic"] == 0.0


def test_one_class_gives_null(spark):
    r = M.evaluate(_frame(spark, [1, 1], [0.1, 0.9])).first()
    assert r["auc"] is None and r["ks_statistic"] is None and r["brier_score"] is not None


def test_log_loss_of_certain_scores(spark):
    r = M.evaluate(_frame(spark, [1, 0], [1.0, 0.0])).first()
    assert 0 <= r["log_loss"] < 1e-12


def test_roc_starts_at_origin(models):
    rows = M.roc_points(models.where("model = 'steps'")).orderBy(F.desc("threshold")).collect()
    assert rows[0]["threshold"] == float("inf") and rows[0]["tpr"] == 0
    assert rows[-1]["tpr"] == 1 and rows[-1]["fpr"] == 1


def test_average_precision(models):
    assert M.average_precision(models.where("model = 'sure'")).first()["average_precision"] == pytest.approx(1.0)


def test_compare_models_sorts_by_gini(models):
    parts = [M.evaluate_model(models.where(F.col("model") == m)) for m in ("level", "sure", "steps")]
    assert [r["model"] for r in M.compare_models(parts).collect()] == ["sure", "steps", "level"]


def test_delong_against_direct_formula(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    a = np.round(rng.random(300) + 0.5 * y, 1)
    b = np.round(rng.random(300) + 0.3 * y, 1)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "a": a, "b": b}))
    r = M.delong_test(df, "label", "a", "b").first()

    def parts(s):
        pos, neg = s[y == 1], s[y == 0]
        win = (pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])
        return win.mean(1), win.mean(0)

    (ua, va), (ub, vb) = parts(a), parts(b)
    m, n = (y == 1).sum(), (y == 0).sum()
    s10, s01 = np.cov(ua, ub), np.cov(va, vb)
    s = s10 / m + s01 / n
    z = (ua.mean() - ub.mean()) / np.sqrt(s[0, 0] + s[1, 1] - 2 * s[0, 1])
    assert r["z"] == pytest.approx(z, abs=1e-9)
    from math import erfc

    assert r["p_value"] == pytest.approx(erfc(abs(z) / 2**0.5), rel=1e-6)


def test_psi_of_hand_counted_shares(spark):
    """Ten reference values a tenth each; the actual ones stand 5 : 3 : 2 in the first, second and last tenth."""
    ref = spark.createDataFrame([(float(k),) for k in range(1, 11)], "x double")
    act = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)] * 3 + [(50.0,)] * 2, "x double")
    eps = 1e-6
    shares = [0.5, 0.3, 0, 0, 0, 0, 0, 0, 0, 0.2]
    want = sum((a - 0.1) * math.log((a + eps) / (0.1 + eps)) for a in shares)
    assert D.psi(ref, act, "x").first()["psi"] == pytest.approx(want, abs=1e-9)


def test_psi_of_tied_values(spark):
    """Edges 0, 1, 2 with counts 6, 3, 1 against 2, 2, 6."""
    ref = spark.createDataFrame([(0.0,)] * 6 + [(1.0,)] * 3 + [(2.0,)], "x double")
    table = D.psi(ref, ref, "x").first()["psi"]
    assert table == pytest.approx(0.0, abs=1e-12)
    moved = spark.createDataFrame([(0.0,)] * 2 + [(1.0,)] * 2 + [(2.0,)] * 6, "x double")
    assert D.psi(ref, moved, "x").first()["psi"] > 0.25


def test_psi_of_itself_is_zero(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert D.psi(df, df, "x").first()["psi"] == pytest.approx(0.0, abs=1e-12)


def test_normal_tail(spark):
    from math import erfc

    for z in (0.0, 0.7, 1.96, -3.5, 6.0):
        got = spark.range(1).select(C.normal_two_sided_p(F.lit(z))).first()[0]
        assert got == pytest.approx(erfc(abs(z) / 2**0.5), rel=3e-7)
