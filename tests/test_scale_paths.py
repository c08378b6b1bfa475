"""The paths taken by large inputs, forced on small ones and checked by brute force."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.operators import isotonic
from creditloom.operators import metrics as M
from creditloom.operators import ranking as R
from creditloom.operators import resampling as Z
from creditloom.operators.quantiles import quantiles
from creditloom.operators.relations import correlation_pairs, vif
from creditloom.operators.smote import buckets, nearest_neighbours, smote
from creditloom.operators.windows import asof_window_join


@pytest.fixture(scope="module")
def wild(spark):
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({
        "tail": np.exp(rng.normal(0, 4, n)),
        "ties": rng.integers(0, 7, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 5.0, rng.normal(0, 1, n)),
        "one": 2.5,
    })
    pdf.loc[rng.random(n) < 0.1, "ties"] = np.nan
    df = spark.createDataFrame(pdf).select(*[C.nan_to_null(c).alias(c) for c in pdf.columns])
    return pdf, df


@pytest.mark.parametrize("bins", [2, 10, 17])
def test_quantiles_by_counting_match_numpy(wild, bins):
    pdf, df = wild
    probs = C.linspace(0.0, 1.0, bins)
    got = quantiles(df, list(pdf.columns), probs)
    for c in pdf.columns:
        np.testing.assert_allclose(got[c], np.quantile(pdf[c].dropna(), probs), rtol=1e-12)


def test_quantiles_of_an_empty_column(spark, wild):
    pdf, df = wild
    got = quantiles(df.withColumn("none", F.lit(None).cast("double")), ["tail", "none"], [0.5])
    assert got["none"] is None
    np.testing.assert_allclose(got["tail"], [np.quantile(pdf["tail"], 0.5)])


def test_quantiles_of_infinite_and_far_spread_values(spark):
    top = float(np.finfo(float).max)
    values = {
        "ends": [-np.inf, -np.inf, 0.0, 25.0, 50.0, np.inf],
        "wide": [-top, -1e-300, 0.0, 5e-324, 1.0, top],
        "close": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0 + 3 * 2**-52, 2.0, 1e18],
        "nan": [np.nan, 1.0, 2.0, 3.0, np.nan, 4.0],
        "all": [np.inf] * 6,
    }
    df = spark.createDataFrame(list(zip(*values.values(), strict=True)), ", ".join(f"{c} double" for c in values))
    got = quantiles(df, list(values), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    for c in ("ends", "wide", "close", "all"):
        assert got[c] == sorted(values[c])
    assert quantiles(df, ["nan"], [0.0, 0.5, 1.0])["nan"] == [1.0, 2.5, 4.0]


@pytest.mark.parametrize(("low", "high", "n", "p", "last_low"), [
    (700.29, 700.2900000000001, 23, 0.3, 6), (219.84333333333333, 219.8433333333334, 39, 0.1, 3),
    (830.6058333333334, 830.6058333333335, 23, 0.2, 4), (242.51916666666668, 242.51916666666673, 29, 0.2, 5),
])
def test_quantiles_between_neighbouring_doubles_are_those_of_the_sql(spark, low, high, n, p, last_low):
    """Values a few last places apart: the rounding of the quantile decides which of them lie above it."""
    values = [low] * (last_low + 1) + [high] * (n - last_low - 1)
    (want,) = duckdb.execute("SELECT quantile_cont(v, ?::DOUBLE) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [p, values]).fetchone()
    assert quantiles(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], [p])["x"] == [want]


def _auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return (np.sum(pos[:, None] > neg[None, :]) + 0.5 * np.sum(pos[:, None] == neg[None, :])) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    n = 1500
    s = np.where(rng.random(n) < 0.35, 0.25, np.round(rng.random(n), 3))
    y = (rng.random(n) < s).astype(int)
    m = np.where(rng.random(n) < 0.9, "a", "b")
    return y, s, m, spark.createDataFrame(pd.DataFrame({"label": y, "score": s, "model": m}))


@pytest.mark.parametrize("slices", [1, 7, 300])
def test_auc_and_ks_by_slices(scored, slices):
    y, s, m, df = scored
    cells = R.cumulative_cells(df, by=["model"], slices=slices)
    got = {r["model"]: r for r in M.metrics_of_cells(cells, ["model"]).collect()}
    for k in "ab":
        yy, ss = y[m == k], s[m == k]
        cuts = np.unique(ss)
        ks = max(0.0, max((ss[yy == 1] >= t).mean() - (ss[yy == 0] >= t).mean() for t in cuts))
        assert got[k]["auc"] == pytest.approx(_auc(yy, ss), abs=1e-12)
        assert got[k]["ks_statistic"] == pytest.approx(ks, abs=1e-12)
        assert got[k]["brier_score"] == pytest.approx(np.mean((ss - yy) ** 2), abs=1e-12)


def test_balanced_slices(scored):
    _, s, _, df = scored
    edges = R.slice_edges(df, "score", slices=8)
    assert 1 < len(edges) <= 7 and edges == sorted(edges)


def test_count_edges_agrees_with_searchsorted(spark):
    edges = list(np.round(np.linspace(-2, 2, 101), 3))
    x = np.concatenate([edges, np.linspace(-3, 3, 57)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    rows = df.select("x", C.count_edges("x", edges).alias("l"), C.count_edges("x", edges, True).alias("r")).collect()
    for r in rows:
        assert r["l"] == np.searchsorted(edges, r["x"], "left")
        assert r["r"] == np.searchsorted(edges, r["x"], "right")


def test_row_ranks_are_a_permutation(spark):
    df = spark.range(997).select("id", (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    pdf = R.row_ranks(df, ["g"], "h", "id").toPandas()
    for _, part in pdf.groupby("g"):
        part = part.sort_values(["h", "id"])
        assert list(part["rank"]) == list(range(len(part)))


@pytest.mark.parametrize("stratified", [False, True])
@pytest.mark.parametrize("per_task", [7, 4096])
def test_bootstrap_is_complete_over_slices(scored, per_task, stratified, monkeypatch):
    y, s, m, df = scored
    monkeypatch.setattr(R, "MAX_SLICES", 8)
    args = dict(iterations=50, seed=7, chunk=20, per_task=per_task, stratified=stratified)
    leaves = Z.cell_draws(df, **args).toPandas()
    # Tasks keep their size, also where the cut points are too few.
    assert leaves["pos"].map(len).max() <= per_task
    draws = {(r["model"], r["draw"]): r for r in Z.bootstrap_draws(df, **args).collect()}
    assert len(draws) == 100
    for model in "ab":
        own, cuts = y[m == model], np.unique(s[m == model])
        n1, n0 = int(own.sum()), int((1 - own).sum())
        for draw, part in leaves[leaves["model"] == model].groupby("draw"):
            assert len(part) == 1 if per_task == 4096 else len(part) >= len(cuts) / 7
            tp, tn = int(part["pos"].map(sum).sum()), int(part["neg"].map(sum).sum())
            assert {(tp, tn)} == set(zip(part["tp"], part["tn"], strict=True)) and tp + tn == n1 + n0
            assert not stratified or (tp, tn) == (n1, n0)
            if per_task == 4096:
                p, n = (np.array(part[c].iloc[0]) for c in ("pos", "neg"))
                before, below = np.cumsum(n) - n, np.cumsum(p) - p
                want = (p * (before + n / 2)).sum() / (tp * tn), max((before / tn - below / tp).max(), 0)
                assert (draws[model, draw]["auc"], draws[model, draw]["ks"]) == pytest.approx(want, abs=1e-12)


def test_bootstrap_slices_agree_with_their_cells(scored, monkeypatch):
    """Cells of all leaves put in score order give the metrics that the leaves add up to."""
    monkeypatch.setattr(R, "MAX_SLICES", 4)
    y, s, m, df = scored
    one = df.where("model = 'a'")
    cells = R.even_slices(R.score_cells(one, "label", "score"), "score", [], 9).select("score", "s1", "s2").toPandas().sort_values("score")
    assert (cells.groupby(["s1", "s2"]).size() <= 9).all() and cells["s1"].is_monotonic_increasing
    leaves = Z.cell_draws(one, iterations=12, seed=3, chunk=5, per_task=9).toPandas()
    draws = {r["draw"]: r for r in Z.bootstrap_draws(one, iterations=12, seed=3, chunk=5, per_task=9).collect()}
    sizes = cells.groupby(["s1", "s2"]).size().to_numpy()
    for draw, part in leaves.groupby("draw"):
        # A leaf is found again by what lies below it: gap and won follow from its cells and the leaves before.
        assert sorted(len(p) for p in part["pos"]) == sorted(sizes)
        assert 0 < draws[draw]["auc"] < 1
        assert part["won"].sum() / (part["tp"].iloc[0] * part["tn"].iloc[0]) == pytest.approx(draws[draw]["auc"], abs=1e-12)


def test_stratified_draws_spread_like_resampled_rows(scored):
    y, s, m, df = scored
    own, score = y[m == "a"], s[m == "a"]
    rng = np.random.default_rng(0)
    pos, neg = score[own == 1], score[own == 0]
    want = []
    for _ in range(200):
        a, b = rng.choice(pos, len(pos)), np.sort(rng.choice(neg, len(neg)))
        want.append(((np.searchsorted(b, a) + np.searchsorted(b, a, "right")) / 2).mean() / len(neg))
    got = [r["auc"] for r in Z.bootstrap_draws(df.where("model = 'a'"), iterations=400, stratified=True, per_task=50).collect()]
    assert np.mean(got) == pytest.approx(np.mean(want), abs=0.004)
    assert np.std(got) == pytest.approx(np.std(want), rel=0.2)


def test_bootstrap_interval_holds_the_auc(scored):
    y, s, m, df = scored
    for r in Z.bootstrap_ci(df, by=["model"], iterations=200).collect():
        own = m == r["model"]
        assert r["auc_ci_lower"] < _auc(y[own], s[own]) < r["auc_ci_upper"]
        assert r["gini_ci_lower"] == pytest.approx(2 * r["auc_ci_lower"] - 1)


def test_inflation_of_constant_and_tied_columns(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=500), rng.normal(size=500)
    pdf = pd.DataFrame({"x": x, "twice": 2 * x, "y": y, "flat": 3.0, "z": y + rng.normal(size=500)})
    got = {r["feature"]: r["vif"] for r in vif(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    assert got["x"] == got["twice"] == np.inf and got["flat"] is None
    r2 = np.corrcoef(y, pdf["z"])[0, 1] ** 2
    assert got["z"] == pytest.approx(1 / (1 - r2), rel=0.05) and got["y"] == pytest.approx(got["z"], rel=0.05)


def test_left_as_of_join_keeps_each_point_once(spark):
    points = spark.createDataFrame([("a", "2020-05-01"), ("a", "2021-05-01"), ("b", "2020-05-01"), (None, "2020-05-01")], "entity string, t0 string")
    points = points.withColumn("t0", F.to_date("t0"))
    daily = spark.createDataFrame([("a", "2020-04-30", 1.0), ("a", "2020-03-01", 2.0), ("b", "2020-06-01", 3.0)], "entity string, day string, v double")
    daily = daily.withColumn("day", F.to_date("day"))
    got = asof_window_join(points, daily, 90, "left").select("entity", F.col("t0").cast("string"), "v", "age").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        ("a", "2020-05-01", 1.0, 1), ("a", "2020-05-01", 2.0, 61), ("a", "2021-05-01", None, None),
        ("b", "2020-05-01", None, None), (None, "2020-05-01", None, None),
    ], key=repr)
    assert asof_window_join(points, daily, 90, "inner").count() == 2


def test_losses_are_plain_means(scored):
    y, s, m, df = scored
    for r in M.point_losses(df).collect():
        own = m == r["model"]
        assert r["brier_score"] == pytest.approx(np.mean((s[own] - y[own]) ** 2), abs=1e-12)
    assert "Window" not in M.point_losses(df)._jdf.queryExecution().executedPlan().toString()


def test_stratified_bootstrap_has_ks(scored):
    r = Z.bootstrap_ci(scored[3], iterations=60, stratified=True).first()
    assert 0 <= r["ks_ci_lower"] <= r["ks_ci_upper"] <= 1


def test_correlation_matches_pandas(wild):
    pdf, df = wild
    want = pdf.corr()
    for r in correlation_pairs(df, list(pdf.columns)).collect():
        w = want.loc[r["feature"], r["other"]]
        assert (r["corr"] is None and np.isnan(w)) or r["corr"] == pytest.approx(w, abs=1e-9)


def _points(spark, x, m=None):
    pdf = pd.DataFrame({"id": np.arange(len(x)), "x": x.tolist(), "m": 1 if m is None else m})
    return spark.createDataFrame(pdf, "id long, x array<double>, m long")


def _recall(x, found, k):
    hits = total = 0
    for i in range(0, len(x), 7):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        limit = np.sort(d)[k - 1]
        got = [n["id"] for n in found.get(i, [])]
        assert len(set(got)) == len(got) and i not in got
        hits += sum(d[j] <= limit + 1e-12 for j in got)
        total += k
    return hits / total


def test_neighbours_in_one_bucket_are_exact(spark):
    x = np.unique(np.round(np.random.default_rng(11).normal(size=(200, 2)), 2), axis=0)
    got = {r["id"]: r["near"] for r in nearest_neighbours(_points(spark, x), 4).collect()}
    assert _recall(x, got, 4) == 1.0


def test_recall_of_neighbours(spark):
    rng = np.random.default_rng(12)
    x = np.unique(np.round(rng.normal(size=(4000, 25)) * np.geomspace(30, 0.1, 25), 4), axis=0)
    got = {r["id"]: r["near"] for r in nearest_neighbours(_points(spark, x), 5, leaf=200).collect()}
    assert _recall(x, got, 5) >= 0.9


@pytest.mark.parametrize("values", [1 << 22, 1])
def test_points_move_once_a_table(spark, monkeypatch, values):
    """Nothing is written on the way to the buckets, whether a table is one part or cut into several ahead."""
    from creditloom.operators import smote as module

    rng = np.random.default_rng(12)
    x = np.unique(np.round(rng.normal(size=(4000, 25)) * np.geomspace(30, 0.1, 25), 4), axis=0)
    monkeypatch.setattr(module, "PART_VALUES", values, raising=False)
    monkeypatch.setattr(module, "stage", None)
    got = {r["id"]: r["near"] for r in nearest_neighbours(_points(spark, x), 5, leaf=200).collect()}
    assert _recall(x, got, 5) >= 0.9
    sizes = buckets(_points(spark, x), leaf=50, tables=2).groupBy("t", "bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
    assert {r["n"] for r in sizes.groupBy("t").agg(F.sum("count").alias("n")).collect()} == {len(x)}


def test_points_send_as_many_neighbours_as_they_need(spark, monkeypatch):
    """Points that ask for fewer neighbours get the same ones, and only these leave the tasks."""
    from creditloom.operators import smote as module

    rng = np.random.default_rng(13)
    x = np.unique(np.round(rng.normal(size=(600, 4)), 3), axis=0)
    sent, nearest = spark.sparkContext.accumulator(0), module._nearest
    need = rng.integers(0, 4, len(x)) * (rng.random(len(x)) < 0.5)

    def counted(*a):
        for found in nearest(*a):
            sent.add(len(found[0]))
            yield found

    want = {r["id"]: r["near"] for r in nearest_neighbours(_points(spark, x), 5, leaf=100, tables=3).collect()}
    monkeypatch.setattr(module, "_nearest", counted)
    points = _points(spark, x).withColumn("need", F.get(F.array(*[F.lit(int(n)) for n in need]), F.col("id").cast("int")))
    got = {r["id"]: r["near"] for r in nearest_neighbours(points, 5, leaf=100, tables=3).collect()}
    assert set(got) == set(np.flatnonzero(need))
    assert all(got[i][: need[i]] == want[i][: need[i]] for i in got)
    assert sent.value == 3 * need.sum()


def test_rows_whose_digest_comes_first(spark):
    from creditloom.operators.ranking import row_ranks
    from creditloom.operators.smote import _first_rows

    rows = spark.range(3000).selectExpr("id % 1000 as id", "id div 1000 as r")
    ranked = row_ranks(rows.withColumn("_h", C.hash_hex(42, F.lit("extra"), "id", "r", width=32)), [], "_h", "id")
    for n in (1, 700, 2999):
        picked = ranked.where(_first_rows(rows, n, 42))
        assert picked.count() == n and picked.agg(F.max("rank")).first()[0] == n - 1


def test_smote_balance_writes_no_projections(spark, sf_dir, monkeypatch):
    """All new rows lie between two rows of their class, in parts cut ahead, and only the distinct points are written."""
    from creditloom.operators import smote as module
    from creditloom.plans.model_queries import cleaned, smote_balance

    cleaned(spark, sf_dir)
    names, stage = [], module.stage
    monkeypatch.setattr(module, "PART_VALUES", 1, raising=False)
    monkeypatch.setattr(module, "stage", lambda df, name: names.append(name) or stage(df, name))
    rows = smote_balance(spark, sf_dir).collect()
    assert names == ["minority-points"]
    assert len({r["n_after"] for r in rows}) == 1 and all(r["n_on_segment"] == r["n_synthetic"] for r in rows)


def test_tied_parts_are_dealt_by_digest(spark, monkeypatch):
    from creditloom.operators import smote as module

    x = np.array([[float(i % 2), 0.0, 1e-12 * i] for i in range(1500)])
    monkeypatch.setattr(module, "PART_VALUES", 1)
    sizes = buckets(_points(spark, x), leaf=50, tables=2).groupBy("t", "bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= 250
    assert {r["n"] for r in sizes.groupBy("t").agg(F.sum("count").alias("n")).collect()} == {1500}


def test_tied_projections_are_cut_by_count(spark):
    # All points on few values of one axis: most cuts coincide.
    x = np.array([[float(i % 2), 0.0, 1e-12 * i] for i in range(1500)])
    sizes = buckets(_points(spark, x), leaf=50, tables=2).groupBy("t", "bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= 250
    assert sizes.groupBy("t").agg(F.sum("count")).collect()[0][1] == 1500


@pytest.fixture(scope="module")
def rare(spark):
    rng = np.random.default_rng(2)
    minority = np.vstack([rng.normal(size=(60, 2)), np.tile([9.0, 9.0], (30, 1))])  # a third are copies
    pdf = pd.DataFrame(np.vstack([minority, rng.normal(size=(400, 2))]), columns=["a", "b"])
    pdf["default_flag"] = [1] * 90 + [0] * 400
    pdf["application_id"] = np.arange(len(pdf))
    return minority, spark.createDataFrame(pdf)


def test_smote_points_lie_on_segments(rare):
    minority, df = rare
    out = smote(df, ["a", "b"], leaf=20, trace=True).toPandas()
    assert set(out["default_flag"]) == {1} and len(out) == 310
    start, end = minority[out["from_id"]], minority[out["to_id"]]
    np.testing.assert_allclose(out[["a", "b"]].to_numpy(), start + out[["step"]].to_numpy() * (end - start), atol=1e-12)
    # Rows that are copies of one another have these for neighbours.
    assert (out.loc[out["from_id"] >= 60, "to_id"] == 60).all() and (out["from_id"] >= 60).sum() in range(90, 121)
    per_row = out.loc[out["from_id"] < 60].groupby("from_id").size()
    assert len(per_row) == 60 and set(per_row) <= {3, 4}
    again = smote(df.repartition(5), ["a", "b"], leaf=20, trace=True).toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, out.to_numpy()))


@pytest.mark.parametrize("ratio, want", [(0.1, 0), (0.5, 110), (0.225, 0)])
def test_smote_makes_exactly_what_is_missing(rare, ratio, want):
    assert smote(rare[1], ["a", "b"], ratio=ratio).count() == want


@pytest.mark.parametrize("per_task", [3, 40, 20_000])
def test_isotonic_blocks_are_sparks_fit(spark, scored, per_task, monkeypatch):
    y, s, m, df = scored
    monkeypatch.setattr(R, "MAX_SLICES", 8)
    noisy = df.select(F.col("label").alias("y"), F.round(F.col("score") + F.rand(4) * 0.4, 3).alias("s")).persist()
    want = IsotonicRegression(featuresCol="s", labelCol="y").fit(noisy).setPredictionCol("want")
    got = isotonic.fit_isotonic(noisy, per_task=per_task).setFeaturesCol("s").setPredictionCol("got")
    grid = spark.range(1400).select((F.col("id") / 1000.0 - 0.1).alias("s")).unionByName(noisy.select("s"))
    assert got.transform(want.transform(grid)).agg(F.max(F.abs(F.col("got") - F.col("want")))).first()[0] < 1e-12
    blocks = isotonic.isotonic_blocks(noisy, "y", "s", per_task=per_task).toPandas().sort_values("lo")
    assert blocks["weight"].sum() == noisy.count() and (np.diff(blocks["value"]) > 0).all() and (blocks["lo"].to_numpy()[1:] > blocks["hi"].to_numpy()[:-1]).all()


def test_isotonic_of_few_and_weighted_rows(spark):
    rows = spark.createDataFrame([(1.0, 0.2, 1.0), (0.0, 0.4, 3.0), (1.0, 0.9, 1.0), (1.0, None, 1.0), (None, 0.1, 1.0), (0.0, 0.1, 0.0)], "label double, score double, w double")
    found = isotonic.isotonic_blocks(rows, weight="w").orderBy("lo").collect()
    assert [tuple(r) for r in found] == [(0.2, 0.4, 4.0, 1.0, 0.25), (0.9, 0.9, 1.0, 1.0, 1.0)]
    assert isotonic.isotonic_blocks(rows.limit(0)).count() == 0
