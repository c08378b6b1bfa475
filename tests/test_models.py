import time
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators import attribution as A
from creditloom.operators import training as T
from creditloom.operators.tree_attribution import Leaf, attribution_tree, base_value, ensemble_leaves

COLS = ["cic_a", "cic_b", "txn_c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 800
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 2] + x[:, 0] * x[:, 1])))).astype(int)
    pdf = pd.DataFrame(x, columns=COLS)
    pdf["default_flag"], pdf["application_id"] = y, np.arange(n)
    return spark.createDataFrame(pdf).persist()


def test_unfitted_raises(data):
    with pytest.raises(T.NotFitted):
        T.LogisticCredit(COLS).transform(data)


def test_logistic(spark, data):
    model = T.LogisticCredit(COLS, max_iter=30, folds=3).fit(data)
    assert model.score(data) > 0.75
    assert model.feature_names == COLS
    coef = model.coefficients(spark).collect()
    assert coef[0]["feature"] == "cic_a" and coef[0]["odds_ratio"] == pytest.approx(np.exp(coef[0]["coefficient"]))
    rows = model.credit_scores(data).agg(F.min("credit_score").alias("a"), F.max("credit_score").alias("b"), F.avg("pd").alias("p")).first()
    assert 300 <= rows["a"] <= rows["b"] <= 850
    rate = data.agg(F.avg("default_flag")).first()[0]
    assert abs(rows["p"] - rate) < 0.05
    assert set(r["predicted"] for r in model.predict(data).select("predicted").distinct().collect()) == {0, 1}


def test_forest_isotonic(spark, data):
    model = T.ForestCredit(COLS, trees=5, depth=3, folds=2).fit(data)
    assert model.score(data) > 0.7
    imp = model.importance(spark).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0, abs=1e-6)
    p = model.transform(data).agg(F.min("pd").alias("a"), F.max("pd").alias("b")).first()
    assert 0 <= p["a"] <= p["b"] <= 1


@pytest.fixture(scope="module")
def boosted(data):
    return T.BoostedCredit(COLS, trees=4, depth=3, rate=0.3).fit(data.where("application_id < 600"), data.where("application_id >= 600"))


def test_tree_attribution_adds_up(data, boosted):
    gbt = boosted.members[0][0]
    out = attribution_tree(data, gbt, COLS)
    total = F.col("base") + sum(F.col(A.phi(f)) for f in COLS)
    pd_col = boosted.transform(data).select("application_id", "pd")
    gap = out.select("application_id", (1 / (1 + F.exp(-total))).alias("p")).join(pd_col, "application_id").agg(F.max(F.abs(F.col("p") - F.col("pd")))).first()[0]
    assert gap < 1e-9


def test_forest_attribution_adds_up(data):
    forest = T.ForestCredit(COLS, trees=3, depth=3, calibrate=False).fit(data)
    out = attribution_tree(data, forest.members[0][0], COLS)
    total = F.col("base") + sum(F.col(A.phi(f)) for f in COLS)
    joined = out.select("application_id", total.alias("p")).join(forest.transform(data).select("application_id", "pd"), "application_id")
    assert joined.agg(F.max(F.abs(F.col("p") - F.col("pd")))).first()[0] < 1e-9


def test_tree_attribution_is_the_shapley_value(spark, data, boosted):
    leaves = ensemble_leaves(boosted.members[0][0], spark)
    row = data.where("application_id = 5").first()
    x = np.array([row[c] for c in COLS])

    def game(known):
        total = 0.0
        for leaf in leaves:
            v = leaf.value
            for f, lo, hi, z in zip(leaf.feature, leaf.lo, leaf.hi, leaf.share):
                v *= float(lo < x[f] <= hi) if f in known else z
            total += v
        return total

    want = []
    for j in range(3):
        rest = [i for i in range(3) if i != j]
        want.append(sum(
            factorial(len(s)) * factorial(2 - len(s)) / factorial(3) * (game({*s, j}) - game(set(s)))
            for r in range(3) for s in combinations(rest, r)
        ))
    got = attribution_tree(data.where("application_id = 5"), boosted.members[0][0], COLS).first()
    np.testing.assert_allclose([got[A.phi(c)] for c in COLS], want, atol=1e-12)
    assert got["base"] == pytest.approx(base_value(leaves))


def test_tree_attribution_without_values(data, boosted):
    """Without the feature columns only what the trees ask for moves; the contributions are the same, 0 for the others."""
    gbt = boosted.members[0][0]
    wide = data.withColumns({f"idle_{i}": F.lit(float(i)) for i in range(3)})
    names = [*COLS, "idle_0", "idle_1", "idle_2"]
    want = {r["application_id"]: r for r in attribution_tree(data, gbt, COLS).collect()}
    got = attribution_tree(wide, gbt, names, values=False)
    assert got.columns == ["application_id", *[A.phi(c) for c in names], "base"]
    assert "idle" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    for r in got.collect():
        assert [r[A.phi(c)] for c in COLS] == [want[r["application_id"]][A.phi(c)] for c in COLS] and r[A.phi("idle_1")] == 0.0
    long = A.long_form(got, values=False)
    assert long.columns == ["application_id", "feature", "phi"] and long.count() == len(names) * len(want)


def test_rounded_is_round(spark):
    from creditloom.functions.columns import rounded

    rng = np.random.default_rng(5)
    ties = (rng.integers(-10**6, 10**6, 2000) + 0.5) / 1e8
    x = [*rng.normal(size=3000).tolist(), *ties.tolist(), *np.nextafter(ties, 1).tolist(), *(rng.normal(size=500) * 1e9).tolist()]
    x += [0.0, -0.0, -1e-12, 1e300, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", rounded("x", 8).alias("got"), F.round("x", 8).alias("want"))
    assert rows.where("not got <=> want").count() == 0


def test_leaf_table_of_one_feature():
    leaf = Leaf(2.0, np.array([0]), np.array([0.0]), np.array([1.0]), np.array([0.25]))
    np.testing.assert_allclose(leaf.table()[:, 0], [-0.5, 1.5])


def test_tables_in_groups_give_the_same(data, boosted, monkeypatch):
    from creditloom.operators import tree_attribution

    gbt = boosted.members[0][0]
    want = {r["application_id"]: r for r in attribution_tree(data, gbt, COLS).collect()}
    monkeypatch.setattr(tree_attribution, "GROUP_BYTES", 300)
    monkeypatch.setattr(tree_attribution, "GATHERED_ROWS", 30)
    leaves = ensemble_leaves(gbt, data.sparkSession)
    groups = tree_attribution.table_groups(leaves, 300)
    assert len(groups) > 3 and sorted(k for g in groups for k in g) == [k for k, leaf in enumerate(leaves) if len(leaf.feature)]
    got = attribution_tree(data.repartition(3), gbt, COLS).collect()
    assert len(got) == len(want)
    for r in got:
        np.testing.assert_allclose([r[A.phi(c)] for c in COLS], [want[r["application_id"]][A.phi(c)] for c in COLS], atol=1e-12)


@pytest.mark.parametrize("make", [
    lambda: T.LogisticCredit(COLS, max_iter=10, folds=2), lambda: T.LogisticCredit(COLS, max_iter=10, calibrate=False),
    lambda: T.ForestCredit(COLS, trees=3, depth=2, folds=2), lambda: T.BoostedAltCredit(COLS, trees=2, depth=2),
])
def test_saved_models_score_the_same(data, tmp_path, make):
    model = make().fit(data)
    model.save(f"{tmp_path}/m")
    with pytest.raises(Exception):
        model.save(f"{tmp_path}/m")
    model.write().overwrite().save(f"{tmp_path}/m")
    for kind in (type(model), T.CreditModel):
        again = kind.load(f"{tmp_path}/m")
        assert type(again) is type(model) and again.settings() == model.settings() and again.feature_names == COLS
        rows = again.transform(model.transform(data).withColumnRenamed("pd", "was"))
        assert rows.where("pd <> was or pd is null").count() == 0
    with pytest.raises(ValueError):
        (T.ForestCredit if not isinstance(model, T.ForestCredit) else T.LogisticCredit).load(f"{tmp_path}/m")


def test_an_unfitted_model_cannot_be_saved(tmp_path):
    with pytest.raises(T.NotFitted):
        T.LogisticCredit(COLS).save(f"{tmp_path}/m")


def test_tune_updates_parameters(data):
    model = T.BoostedCredit(COLS)
    best = model.tune(data, trials=2, folds=2, space={"n_estimators": (1, 2), "max_depth": (2, 2)})
    assert model.params["depth"] == 2 and model.params["trees"] == best["maxIter"]
    assert 0.5 < model.best_auc <= 1


@pytest.fixture(scope="module")
def contrib(spark):
    rng = np.random.default_rng(1)
    names = [f"cic_f{i}" for i in range(3)] + [f"behav_f{i}" for i in range(3)]
    pdf = pd.DataFrame(rng.normal(size=(300, 6)) * [2, 2, 2, 1, 1, 1], columns=names)
    for n in names:
        pdf[A.phi(n)] = pdf[n]
    pdf["application_id"], pdf["base"] = np.arange(300), 0.0
    return spark.createDataFrame(pdf)


def test_attribution_tables(contrib):
    imp = A.mean_abs(contrib)
    values = [r["mean_abs_shap"] for r in imp.collect()]
    assert values == sorted(values, reverse=True)
    names = A.features_of(contrib)
    groups = A.group_by_map(imp, {"bureau": names[:3], "behavioural": names[3:]}).collect()
    assert sum(g["pct_contribution"] for g in groups) == pytest.approx(100, abs=0.011)
    assert groups[0]["group"] == "bureau" and groups[0]["pct_contribution"] > 55
    share = A.bureau_vs_rest(imp).first()
    assert share["bureau_pct"] > share["rest_pct"]
    assert [r["rank"] for r in A.top_features(imp, 4).collect()] == [1, 2, 3, 4]
    assert A.prune_list(imp).count() == 0


def test_row_reports(contrib):
    top = A.adverse_actions(contrib).where("application_id = 7").orderBy("rank").collect()
    one = contrib.where("application_id = 7").first()
    want = sorted((one[A.phi(f)] for f in A.features_of(contrib)), reverse=True)[:3]
    assert [r["phi"] for r in top] == pytest.approx(want)
    fall = A.waterfall_row(contrib, 7, 4).collect()
    assert len(fall) == 4 and abs(fall[0]["phi"]) >= abs(fall[-1]["phi"])
    dep = A.dependence_points(contrib, "cic_f0")
    assert dep.count() == 300 and dep.first()["interaction"] != "cic_f0"


def test_rows_of_one_small_file_are_dealt_to_parts(spark, monkeypatch):
    """Copies compress well: one partition of files may hold far more rows than a task should train on."""
    from creditloom.operators import training

    df = spark.range(2000).selectExpr("id as application_id", "id % 2 as default_flag", "double(id % 7) as x").coalesce(1)
    model = training.LogisticCredit(["x"], max_iter=2, calibrate=False)
    monkeypatch.setattr(training, "PARTITION_BYTES", 72 * 100)
    seen = []
    monkeypatch.setattr(model, "_fit_one", lambda data, val: seen.extend([data.rdd.getNumPartitions(), data.count()]))
    model.fit(df)
    assert seen == [20, 2000]


@pytest.mark.parametrize(("fold_bytes", "at_once"), [(1 << 30, 3), (1, 1)])
def test_folds_have_parts_by_cores_and_share_the_memory(spark, monkeypatch, fold_bytes, at_once):
    """Parts follow the cores and rows, not the shuffle; folds that do not fit together are fitted one after the other."""
    seen, running, most = [], [], []
    monkeypatch.setattr(T, "FOLD_BYTES", fold_bytes, raising=False)
    monkeypatch.setattr(T, "fit_platt", lambda held: running.pop() and T.Sigmoid(1.0, 0.0))

    class Estimator:
        def fit(self, rows):
            running.append(1)
            time.sleep(1.0)
            most.append(len(running))
            seen.append(rows.rdd.getNumPartitions())
            return self

        def transform(self, rows):
            return rows.withColumn("rawPrediction", F.col("_x"))

    model = T.LogisticCredit(["a", "b"], key="id", label="y", folds=3)
    monkeypatch.setattr(model, "estimator", Estimator)
    rows = spark.range(2000).selectExpr("id", "cast(id % 3 = 0 as int) as y", "id * 1.0D as a", "id % 7 * 1.0D as b")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        model.fit(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert max(seen) <= spark.sparkContext.defaultParallelism
    assert max(most) == at_once
    assert len(model.members) == 3


def test_training_rows_of_the_folds_are_held_once(spark, data, monkeypatch):
    """The folds are held; the rows that they are dealt from are not held beside them."""
    held, deal = [], T.stratified_folds
    monkeypatch.setattr(T, "stratified_folds", lambda df, *a: held.append(df.storageLevel.useMemory) or deal(df, *a))
    model = T.ForestCredit(COLS, trees=2, depth=2, folds=2).fit(data)
    assert held == [False]
    assert model.transform(data).where("pd is null").count() == 0


def test_cleaned_rows_carry_the_date(spark, sf_dir):
    """Months of predictions need no join with the applications."""
    from creditloom.plans import model_queries as Q

    assert "application_date" in Q.cleaned(spark, sf_dir).columns and "application_date" not in Q.FEATURES


def test_scoring_adds_no_column_that_nobody_reads(data):
    model = T.ForestCredit(COLS, trees=2, depth=2, folds=2).fit(data)
    plan = model.transform(data)._jdf.queryExecution().analyzed().toString()
    assert "probability" in plan and "rawPrediction" not in plan and "prediction" not in plan and "_keep_" not in plan
    linear = T.LogisticCredit(COLS, max_iter=5, folds=2).fit(data)
    out = linear.transform(data)
    assert out.columns == [*data.columns, "pd"] and out.join(data, COLS).count() == data.count()
    assert "probability" not in out._jdf.queryExecution().analyzed().toString()


def test_reloaded_models_score_apart(spark, sf_dir):
    """The two scorings of a row are not generated as one method."""
    from creditloom.plans import model_queries as Q

    plan = Q.model_reload(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Coalesce") == len(Q.RELOADED)


def test_training_rows_have_no_more_parts_than_rows_and_cores_need(spark, monkeypatch):
    monkeypatch.setattr(T, "PARTITION_BYTES", 72 * 500)
    df = spark.range(2000).selectExpr("id as application_id", "id % 2 as default_flag", "double(id % 7) as x").coalesce(1)
    model, seen = T.LogisticCredit(["x"], max_iter=2, calibrate=False), []
    monkeypatch.setattr(model, "_fit_one", lambda data, val: seen.extend([data.rdd.getNumPartitions(), data.count()]))
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        model.fit(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen == [spark.sparkContext.defaultParallelism, 2000]


def test_scores_are_made_once_for_the_calibration(spark):
    """The cells are counted, cut and pooled, but the scores that they come from are made once."""
    from creditloom.operators.isotonic import fit_isotonic

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        made.add(1)
        return x / 7

    rows = spark.range(500).select((F.col("id") % 3 % 2).cast("double").alias("y"), score(F.col("id").cast("double")).alias("s"))
    fit_isotonic(rows, per_task=50)
    assert made.value == 500


def test_registered_forest_is_whole(spark, data, monkeypatch):
    """``train_forest`` fits the model's own 300 trees of depth 8 for each of five calibration folds."""
    from creditloom.plans import model_queries as Q

    monkeypatch.setattr(Q, "cleaned", lambda *a: data.withColumn("split", F.lit("train")))
    monkeypatch.setattr(Q, "_models", {})
    monkeypatch.setattr(T.ForestCredit, "fit", lambda self, *a: self)
    model = Q.fitted(spark, "own rows", "forest")
    assert model.settings() == {"trees": 300, "depth": 8, "min_leaf": 20} == T.ForestCredit(Q.FEATURES).settings()
    assert model.folds == 5 and model.calibration == "isotonic" and model.features == Q.FEATURES
    made = model.estimator()
    assert (made.getNumTrees(), made.getMaxDepth(), made.getMinInstancesPerNode()) == (300, 8, 20)


@pytest.mark.parametrize(("depth", "min_leaf"), [(8, 1), (1, 20), (3, 1000)])
def test_block_scores_are_those_of_spark(spark, data, depth, min_leaf):
    """The probabilities of Spark's own model, bit by bit: at cuts, beyond them, of rows that come twice and of trees that are one leaf."""
    from pyspark.ml.functions import vector_to_array

    model = T.ForestCredit(COLS, trees=7, depth=depth, min_leaf=min_leaf, calibrate=False).fit(data)
    forest = model.members[0][0]
    cuts = [float(v) for v in np.random.default_rng(1).choice([r["cic_a"] for r in data.collect()], 40)]
    odd = spark.createDataFrame([(v, w, -0.0) for v in cuts for w in (float("inf"), -1e300, 0.0)] * 2, ", ".join(f"{c} double" for c in COLS))
    rows = model._vectors(data.select(*COLS).unionByName(odd))
    both = forest.transform(rows).select(vector_to_array("probability")[1].alias("was"), "_x")
    got = T.forest_probabilities(both, [forest, forest], "_x", "now")
    assert got.count() == 800 + 240
    assert got.where("now[0] <> was or now[1] <> was or was is null or now is null or size(now) <> 2").count() == 0
    nothing = model.transform(data.where("false"))
    assert nothing.columns == [*data.columns, "pd"] and nothing.count() == 0
    with pytest.raises(Exception, match="(?i)null"):
        model.transform(data.withColumn("cic_a", F.lit(None).cast("double"))).collect()


def test_forest_scores_rows_dealt_anew(spark, data, monkeypatch):
    """A small file may hold many rows, and a forest takes long for each."""
    from creditloom.plans import model_queries as Q

    monkeypatch.setattr(Q, "FEATURES", COLS)
    monkeypatch.setattr(Q, "cleaned", lambda *a: data.withColumn("split", F.lit("test")))
    monkeypatch.setattr(Q, "_models", {})
    key = spark.sparkContext.applicationId, "own rows"
    Q._models[(*key, "forest")] = forest = T.ForestCredit(COLS, trees=2, depth=2, folds=2).fit(data)
    Q._models[(*key, "boosted")] = T.BoostedCredit(COLS, trees=2, depth=2).fit(data)
    dealt = Q.train_forest(spark, "own rows")
    assert "REBALANCE" in dealt._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE" not in Q.train_boosted(spark, "own rows")._jdf.queryExecution().executedPlan().toString()
    want = forest.transform(data).select("application_id", F.round("pd", 6).alias("was"))
    assert dealt.join(want, "application_id").where("pd = was").count() == dealt.count() == 800


@pytest.mark.parametrize(("trees", "at_once"), [(1, 3), (100, 1)])
def test_draws_of_the_trees_count_for_folds_at_once(spark, monkeypatch, trees, at_once):
    """Beside its vector a row of a fold holds how often each tree draws it."""
    running, most = [], []
    monkeypatch.setattr(T, "FOLD_BYTES", 2000 * 100 * 3)
    monkeypatch.setattr(T, "fit_steps", lambda held: running.pop())

    class Estimator:
        def fit(self, rows):
            running.append(1)
            time.sleep(1.0)
            most.append(len(running))
            return self

    model = T.ForestCredit(["a"], trees=trees, key="id", label="y", folds=3)
    monkeypatch.setattr(model, "estimator", Estimator)
    monkeypatch.setattr(model, "_positives", lambda df, *a: df.withColumn("_s0", F.lit(0.5)))
    model.fit(spark.range(2000).selectExpr("id", "cast(id % 3 = 0 as int) as y", "id * 1.0D as a"))
    assert max(most) == at_once
