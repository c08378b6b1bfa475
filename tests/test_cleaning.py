import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators import cleaning as K
from creditloom.operators import features as X
from creditloom.operators import splits as P
from creditloom.sources import tables as IO


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(9)
    n = 500
    pdf = pd.DataFrame({c: rng.normal(0.6, 0.5, n) for c in S.CLEANER_NUMERIC})
    # Every bounded column leaves its bounds on both sides.
    for c, (lo, hi) in S.CLIP_BOUNDS.items():
        if c in pdf:
            pdf[c] = lo + (hi - lo) * rng.uniform(-0.3, 1.4, n)
    for c in S.BUREAU:
        pdf.loc[rng.random(n) < 0.2, c] = np.nan
    pdf["employment_type"] = rng.choice(["clerk", "farmer", "trader"], n)
    pdf["default_flag"] = rng.integers(0, 2, n)
    pdf["application_id"] = np.arange(n)
    return IO.normalise_missing(spark.createDataFrame(pdf)).persist()


@pytest.fixture(scope="module")
def cleaned(raw):
    return K.CreditCleaner().fit(raw).transform(raw).toPandas()


def test_no_nulls_and_target_absent(cleaned):
    assert not cleaned.isnull().any().any()
    assert "default_flag" not in cleaned and "employment_type" not in cleaned


def test_clipped_and_flagged(cleaned):
    for c, (lo, hi) in S.CLIP_BOUNDS.items():
        assert cleaned[c].between(lo, hi).all()
    assert all(f"{c}_missing" in cleaned for c in S.BUREAU)
    assert set(cleaned["cic_credit_utilization_missing"]) == {0, 1}


def test_train_fit_applies_to_other_rows(raw):
    model = K.CreditCleaner(apply_scaling=True, keep_encoded=True).fit(raw.where("application_id < 300"))
    out = model.transform(raw.where("application_id >= 300"))
    assert out.count() == 200
    assert "employment_type_encoded" in out.columns
    back = model.transform(raw.where("application_id < 300")).agg(
        F.avg("age_at_application").alias("m"), F.stddev_pop("age_at_application").alias("s")
    ).first()
    assert back["m"] == pytest.approx(0, abs=1e-9) and back["s"] == pytest.approx(1)


def test_medians_are_of_clipped_values(raw):
    model = K.CreditCleaner().fit(raw)
    pdf = raw.toPandas()
    want = pdf["cic_credit_utilization"].clip(0, 1).median()
    assert model.medians["cic_credit_utilization"] == pytest.approx(want)


def test_describe_missing(spark, raw):
    rows = K.describe_missing(raw).collect()
    assert {r["column"] for r in rows} == set(S.BUREAU)
    assert [r["pct_missing"] for r in rows] == sorted((r["pct_missing"] for r in rows), reverse=True)
    assert K.describe_missing(spark.createDataFrame([(1, 2.0)], "a int, b double")).columns == ["column", "n_missing", "pct_missing", "dtype"]
    assert K.describe_missing(spark.createDataFrame([(1, 2.0)], "a int, b double")).count() == 0


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(C.clip("x", 0.0, 1.0)).collect()] == [None, 0.0, 1.0]


def test_label_encoding_rules(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    codes = K.category_codes(df, "c")
    assert {r["category"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, "nan": 2}
    new = spark.createDataFrame([("zzz",), ("b",), (None,)], "c string")
    assert [r["e"] for r in K.label_encode(new, "c", codes, "e").collect()] == [0, 1, 2]


def test_label_encoding_by_join(spark, monkeypatch):
    monkeypatch.setattr(K, "LITERAL_CATEGORIES", 1)
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "c string")
    out = K.label_encode(spark.createDataFrame([("c",), ("x",)], "c string"), "c", K.category_codes(df, "c"), "e")
    assert {r["c"]: r["e"] for r in out.collect()} == {"c": 2, "x": 0}


def test_schema_and_suffix_errors(spark, tmp_path):
    with pytest.raises(IO.SchemaError, match="default_flag"):
        IO.validate_schema(spark.createDataFrame([(1,)], "a int"))
    with pytest.raises(ValueError, match="suffix"):
        IO.read_table(spark, "/nowhere/table.xlsx")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        IO.read_table(spark, str(tmp_path / "absent.parquet"))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a1", 1.5, 1), ("a2", None, 0)], "application_id string, cic_credit_utilization double, default_flag int")
    where = IO.write_table(df, str(tmp_path / "t"))
    for fmt in ("csv", "parquet"):
        back = IO.read_table(spark, where[fmt], required=["default_flag"])
        assert sorted(map(tuple, back.select(df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_split_shares_and_strata(spark):
    df = spark.range(5000).select(F.col("id").alias("application_id"), (F.col("id") % 6 == 0).cast("int").alias("default_flag"))
    rows = P.stratified_split(df, exact=True).groupBy("split").agg(F.count("*").alias("n"), F.avg("default_flag").alias("r")).collect()
    got = {r["split"]: (r["n"], r["r"]) for r in rows}
    assert {k: v[0] for k, v in got.items()} == {"train": 3000, "val": 1000, "test": 1000}
    assert all(abs(v[1] - 1 / 6) < 0.001 for v in got.values())
    sizes = [r["n"] for r in P.stratified_folds(df).groupBy("fold", "default_flag").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10


def test_adaptive_builders(spark):
    df = spark.createDataFrame([(1, 3.0, 0.0)], "application_id int, cic_num_delinquencies double, cic_account_age_months double")
    out = X.build_bureau(df)
    assert "cic_delinquency_rate" in out.columns and "cic_dual_leverage" not in out.columns
    assert out.first()["cic_delinquency_rate"] == 3.0


def test_credit_score_points(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (1.0,), (None,), (1 / 51,)], "p double")
    got = [r[0] for r in df.select(C.credit_score("p")).collect()]
    assert got[:4] == [487, 850, 300, None]
    assert got[4] in (599, 600)  # exactly 600 before truncation, up to the last bit


def test_segments_overlap(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 50.0)], "application_id int, cic_account_age_months double")
    rows = X.with_segments(df, X.segment_tests()).groupBy("segment").count().collect()
    assert {r["segment"]: r["count"] for r in rows} == {"all": 3, "no_bureau": 1, "thin_file": 2}


def test_dedupe_hot_key(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (1, 3, "a"), (2, 1, "z")], "k int, o int, v string")
    assert sorted(map(tuple, K.dedupe(df, "k", ["o", "v"]).collect())) == [(1, 3, "a"), (2, 1, "z")]


def test_saved_cleaner_and_encoders(spark, sf_dir, tmp_path):
    from creditloom.operators.binning import IvSelector, WoeEncoder
    from creditloom.sources.testbed import applications

    df = applications(spark, sf_dir)
    names = ["cic_num_delinquencies", "cic_account_age_months", "age_at_application"]
    cleaner = K.CreditCleaner(keep_label=True, keep_encoded=True, apply_scaling=True).fit(df)
    encoder = WoeEncoder(min_bin_share=0.1).fit(df, names)
    selector = IvSelector(iv_threshold=0.0, flag_leakage=False).fit(df, names)
    for thing, name in ((cleaner, "cleaner"), (encoder, "encoder"), (selector, "selector")):
        thing.save(f"{tmp_path}/{name}")
        again = type(thing).load(f"{tmp_path}/{name}")
        was, now = thing.transform(df), again.transform(df)
        assert was.columns == now.columns and was.exceptAll(now).count() == 0
    assert again.selected == selector.selected and again.report().collect() == selector.report().collect()
    assert WoeEncoder.load(f"{tmp_path}/encoder").iv_table().collect() == encoder.iv_table().collect()


@pytest.mark.parametrize("hot", ["x0", None])
def test_long_code_tables_split_hot_categories(spark, monkeypatch, hot):
    monkeypatch.setattr(K, "LITERAL_CATEGORIES", 2)
    monkeypatch.setattr(K, "LITERAL_FOLDS", 2)
    monkeypatch.setattr(K, "SALTS", 4)
    rows = [(i, hot if i % 3 == 0 else f"x{i}", i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "application_id long, c string, default_flag int").repartition(3)
    assert K.hot_keys(df, F.col("c")) == [hot]
    codes = K.category_codes(df.where("application_id < 2000 and application_id > 2"), "c")
    want = {r["category"]: r["code"] for r in codes.collect()}
    got = K.label_encode(df, "c", codes).collect()
    assert len(got) == 3000
    assert all(r["c_encoded"] == want.get("nan" if r["c"] is None else r["c"], 0) for r in got)
    long = {r["application_id"]: r["c_te"] for r in K.target_encode_oof(df, "c").collect()}
    monkeypatch.setattr(K, "LITERAL_FOLDS", 10_000)
    assert {r["application_id"]: r["c_te"] for r in K.target_encode_oof(df, "c").collect()} == pytest.approx(long)


def test_no_task_holds_a_hot_category(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(90_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id"))).alias("c"))
        table = df.select(F.col("c").alias("k")).distinct().withColumn("code", F.length("k"))
        out = K.spread_join(df, F.col("c"), table, "k")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 90_000 and max(sizes) < 1.6 * 90_000 / len(sizes) and out.where("code is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_predictions_of_other_models_stay(spark, tmp_path):
    from creditloom.sources.tables import write_predictions

    rows = [(i, m, t, float(i)) for i in range(20) for m in ("a", "b") for t in ("2020-01", "2020-02")]
    scored = spark.createDataFrame(rows, "id int, model string, month string, score double")
    where = write_predictions(scored, {"all": scored.groupBy("model").count()}, str(tmp_path), period="month")["predictions"]
    files = lambda: {p.name for p in tmp_path.rglob("predictions/**/part-*.parquet") if "model=b/month=2020-02" not in str(p)}
    before = files()
    write_predictions(scored.where("model = 'b' and month = '2020-02' and id < 5"), {}, str(tmp_path), period="month")
    assert files() == before
    got = {(r["model"], str(r["month"])): r["count"] for r in spark.read.parquet(where).groupBy("model", "month").count().collect()}
    assert got == {("a", "2020-01"): 20, ("a", "2020-02"): 20, ("b", "2020-01"): 20, ("b", "2020-02"): 5}


def test_monthly_counts_add_up(spark):
    from creditloom.operators import drift as D

    rng_rows = [(i, f"m{i % 3}", float((i * 37) % 101), None if i % 11 == 0 else float(i % 7)) for i in range(900)]
    df = spark.createDataFrame(rng_rows, "id int, month string, a double, b double")
    state = D.reference_state(df.where("id < 300"), ["a", "b"], 5)
    one = D.period_counts(df, state, ["month"])
    two = D.add_counts(D.period_counts(df.where("id < 450"), state, ["month"]), D.period_counts(df.where("id >= 450"), state, ["month"]))
    key = lambda t: sorted(map(str, t.collect()))
    assert key(two.select("month", "feature", "n")) == key(one.select("month", "feature", "n"))
    psi = {(r["month"], r["feature"]): r["psi"] for r in D.psi_of_counts(two, state).collect()}
    ref = df.where("id < 300").select("a", F.lit(False).alias("act"))
    now = df.where("month = 'm1'").select("a", F.lit(True).alias("act"))
    want = D.psi_per_feature(ref.unionByName(now), ["a"], F.col("act"), D.reference_edges(df.where("id < 300"), ["a"], 5)).first()["psi"]
    assert psi["m1", "a"] == pytest.approx(want, abs=1e-12)
