"""Model training, scoring, bootstrap intervals. Fits are checked by rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.operators import cleaning as K
from creditloom.operators import isotonic as I
from creditloom.operators import metrics as M
from creditloom.operators import resampling as Z
from creditloom.operators import splits as P
from creditloom.operators import training as T
from creditloom.operators.smote import smote as oversample
from creditloom.plans.catalog import query
from creditloom.plans.sqltext import APPS, SCORES, SPLIT
from creditloom.sources import tables as IO
from creditloom.sources.testbed import applications, long_scores, scores

ID = "application_id"
_models: dict = {}


def cleaned(spark, sf):
    """Clean train/val/test rows with label, date and split, staged once: every fit reads them."""
    key = (spark.sparkContext.applicationId, sf, "cleaned")
    if key not in _models:
        df = applications(spark, sf).select(ID, "application_date", "employment_type", S.TARGET, *S.CLEANER_NUMERIC)
        parts = P.stratified_split(df)
        cleaner = K.CreditCleaner(keep_label=True).fit(parts.where("split = 'train'"))
        _models[key] = IO.stage(cleaner.transform(parts), "cleaned")
    return _models[key]


FEATURES = [*S.CLEANER_NUMERIC, *[f"{c}_missing" for c in S.BUREAU]]


def fitted(spark, sf, name: str):
    """One fit per session and model; the forest is whole, the other fits run shorter than their defaults to keep the check quick."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _models:
        df = cleaned(spark, sf)
        train, val = df.where("split = 'train'"), df.where("split = 'val'")
        make = {
            "logistic": lambda: T.LogisticCredit(FEATURES, max_iter=20),
            "logistic_plain": lambda: T.LogisticCredit(FEATURES, max_iter=20, calibrate=False),
            "forest": lambda: T.ForestCredit(FEATURES),
            "boosted": lambda: T.BoostedCredit(FEATURES, trees=10, depth=4, rate=0.2),
            "boosted_alt": lambda: T.BoostedAltCredit(FEATURES, trees=8, depth=4, rate=0.2),
        }
        model = make[name]()
        _models[key] = model.fit(train, val if name == "boosted" else None)
    return _models[key]


def _to_score(spark, sf, name):
    """The cleaned rows. A forest takes long for a row, and a small file may hold many: for it they are dealt anew."""
    df = cleaned(spark, sf)
    return df.hint("rebalance") if name == "forest" else df


def _scored(spark, sf, name, *more):
    """Every application scored, with the split it belongs to, and more of its columns."""
    out = fitted(spark, sf, name).transform(_to_score(spark, sf, name))
    return out.select(ID, S.TARGET, "split", *more, F.round("pd", 6).alias("pd"))


@query("model_contract")
def model_contract(spark, sf):
    scored = fitted(spark, sf, "logistic_plain").predict(cleaned(spark, sf))
    return scored.groupBy("split", "predicted").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("pd").alias("mean_pd"))


RELOADED = ["logistic", "forest", "boosted"]
#: More partitions than there are: ``coalesce`` then moves nothing, but what comes before and after it is compiled on its own. Both
#: scorings in one generated method are too long for the JVM to compile.
APART = 1 << 20


@query(
    "model_reload",
    APPS + f"SELECT model, {SPLIT} AS split, count(*) AS n_rows, count(*) AS n_equal FROM applications, (SELECT unnest({RELOADED}) AS model) GROUP BY ALL",
)
def model_reload(spark, sf):
    """Rows that a saved and loaded model scores exactly like the fitted one."""
    out = None
    for name in RELOADED:
        model = fitted(spark, sf, name)
        path = f"{IO.shared_folder(spark)}/model-{uuid.uuid4().hex}"
        model.save(path)
        was = model.transform(_to_score(spark, sf, name).select("split", *FEATURES)).withColumnRenamed("pd", "was")
        both = type(model).load(path).transform(was.coalesce(APART))
        rows = both.groupBy(F.lit(name).alias("model"), "split").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("pd") == F.col("was")).cast("long")).alias("n_equal")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("train_logistic")
def train_logistic(spark, sf):
    return _scored(spark, sf, "logistic_plain")


@query("platt_calibration")
def platt_calibration(spark, sf):
    return _scored(spark, sf, "logistic")


@query("coefficients")
def coefficients(spark, sf):
    return fitted(spark, sf, "logistic").coefficients(spark)


@query("train_forest")
def train_forest(spark, sf):
    return _scored(spark, sf, "forest")


@query("isotonic_calibration")
def isotonic_calibration(spark, sf):
    """Discrimination of the calibrated forest per split."""
    df = _scored(spark, sf, "forest")
    return M.evaluate_model(df.select(F.col(S.TARGET).alias("label"), "split", F.col("pd").alias("score")), by=["split"])


@query(
    "isotonic_fit",
    SCORES + """
, c AS (SELECT p_base AS score, count(*) AS w, sum(label) AS y FROM scores GROUP BY p_base)
, r AS (SELECT *, row_number() OVER (ORDER BY score) AS i, sum(w) OVER (ORDER BY score) AS cw, sum(y) OVER (ORDER BY score) AS cy FROM c)
, av AS (SELECT a.i AS j, b.i AS k, (b.cy - a.cy + a.y) / (b.cw - a.cw + a.w)::DOUBLE AS m FROM r a JOIN r b ON b.i >= a.i)
, lo AS (SELECT k, min(m) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM av)
SELECT score, w AS n_rows, round(fit, 9) AS fitted, coalesce(fit >= lag(fit) OVER (ORDER BY score) - 1e-12, TRUE) AS rising
FROM (SELECT r.score, r.w, max(lo.m) AS fit FROM r JOIN lo ON lo.k = r.i GROUP BY ALL)
""",
)
def isotonic_fit(spark, sf):
    """The calibrated value of every distinct score, fitted over all rows."""
    rows = scores(spark, sf).select("label", F.col("p_base").alias("score"))
    model = I.fit_isotonic(rows, "label", "score", per_task=200).setFeaturesCol("score").setPredictionCol("fitted")
    fitted = model.transform(rows.groupBy("score").agg(F.count(F.lit(1)).alias("n_rows")))
    # One row a distinct score, compared with the one before it.
    before = F.lag("fitted").over(Window.orderBy("score"))
    return fitted.select("score", "n_rows", F.round("fitted", 9).alias("fitted"), F.coalesce(F.col("fitted") >= before - 1e-12, F.lit(True)).alias("rising"))


@query("train_boosted")
def train_boosted(spark, sf):
    return _scored(spark, sf, "boosted")


@query("train_boosted_alt")
def train_boosted_alt(spark, sf):
    return _scored(spark, sf, "boosted_alt")


@query("tree_importance")
def tree_importance(spark, sf):
    return fitted(spark, sf, "forest").importance(spark)


@query("tune")
def tune(spark, sf):
    """A short search: two settings, two folds."""
    model = T.BoostedCredit(["cic_num_delinquencies", "cic_payment_history_score", "age_at_application"])
    train = cleaned(spark, sf).where("split = 'train'")
    best = model.tune(train, trials=2, folds=2, space={"n_estimators": (2, 3), "max_depth": (2, 3)})
    return spark.createDataFrame([(k, str(v), float(model.best_auc)) for k, v in sorted(best.items())], "parameter string, value string, auc double")


@query("score_table")
def score_table(spark, sf):
    return fitted(spark, sf, "logistic").credit_scores(cleaned(spark, sf)).select(ID, F.round("pd", 6).alias("pd"), "credit_score")


@query("write_predictions")
def write_predictions(spark, sf):
    parts = [
        _scored(spark, sf, n).select(ID, F.col(S.TARGET).alias("label"), "split", F.lit(n).alias("model"), F.col("pd").alias("score"))
        for n in ("logistic_plain", "boosted")
    ]
    scored = parts[0].unionByName(parts[1])
    folder = f"{IO.shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    where = IO.write_predictions(scored, {"comparison": M.compare_models([M.evaluate_model(scored)])}, folder)
    return spark.read.parquet(where["predictions"]).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("score"), 6).alias("mean_pd")
    )


@query(
    "prediction_partitions",
    APPS + """
SELECT model, strftime(application_date, '%Y-%m') AS month, count(*) AS n_rows, sum(default_flag)::BIGINT AS n_defaults, model = 'boosted' AND month = '1995-03' AS rewritten
FROM applications, (SELECT unnest(['logistic_plain', 'boosted']) AS model) GROUP BY ALL
""",
)
def prediction_partitions(spark, sf):
    """Predictions by model and month after a second run that scores one month with one model."""
    month = F.date_format("application_date", "yyyy-MM").alias("month")

    def rows(name):
        return _scored(spark, sf, name, month).select(ID, F.col(S.TARGET).alias("label"), F.lit(name).alias("model"), "month", F.col("pd").alias("score"))

    folder = f"{IO.shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    first = rows("logistic_plain").unionByName(rows("boosted")).withColumn("rewritten", F.lit(False))
    IO.write_predictions(first, {}, folder, period="month")
    again = rows("boosted").where("month = '1995-03'").withColumn("rewritten", F.lit(True))
    where = IO.write_predictions(again, {}, folder, period="month")
    return spark.read.parquet(where["predictions"]).groupBy("model", F.col("month").cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_defaults"), F.max("rewritten").alias("rewritten")
    )


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return Z.bootstrap_ci(long_scores(spark, sf), iterations=1000)


@query("evaluate_model_ci")
def evaluate_model_ci(spark, sf):
    """The report row with its interval columns."""
    df = long_scores(spark, sf)
    return M.evaluate_model(df, intervals=Z.bootstrap_ci(df, iterations=1000))


@query("stratified_bootstrap")
def stratified_bootstrap(spark, sf):
    return Z.bootstrap_ci(long_scores(spark, sf), iterations=1000, stratified=True)


def _oversampled(spark, sf):
    return oversample(cleaned(spark, sf).where("split = 'train'"), FEATURES, trace=True)


@query("smote")
def smote(spark, sf):
    """Synthetic rows over all features of the cleaned training rows."""
    return _oversampled(spark, sf).drop("from_id", "to_id", "step")


@query(
    "smote_balance",
    APPS + f"""
, n AS (SELECT default_flag AS label, count(*) AS n_rows FROM applications WHERE {SPLIT} = 'train' GROUP BY default_flag)
, m AS (SELECT *, max(n_rows) OVER () - n_rows AS made FROM n)
SELECT label, n_rows, made AS n_synthetic, n_rows + made AS n_after, made AS n_on_segment FROM m
""",
)
def smote_balance(spark, sf):
    """Class sizes before and after, and how many new rows lie between two rows of their class."""
    train = cleaned(spark, sf).where("split = 'train'")
    new = _oversampled(spark, sf)
    sizes = P.class_counts(train)
    # Only rows of a class that is short of rows can be the ends of new rows of that class; a new row with another end stays, unmatched.
    short = train.where(F.col(S.TARGET).isin([y for y, n in sizes.items() if n < max(sizes.values())]))
    ends = short.select(F.col(ID).cast("long").alias("id"), F.col(S.TARGET).alias("y"), F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"))
    a, b = (ends.select(F.col("id").alias(f"{c}_id"), F.col("y").alias(f"{c}_y"), F.col("x").alias(f"{c}_x")) for c in ("from", "to"))
    near = F.lit(True)
    for i, f in enumerate(FEATURES):
        lo, hi = F.get("from_x", F.lit(i)), F.get("to_x", F.lit(i))
        near = near & (F.abs(F.col(f) - (lo + F.col("step") * (hi - lo))) <= (F.abs(lo) + F.abs(hi) + 1.0) * 1e-9)
    mine = near & (F.col("from_y") == F.col(S.TARGET)) & (F.col("to_y") == F.col(S.TARGET))
    # The new rows come dealt by ``to_id``.
    made = new.join(b, "to_id", "left").join(a, "from_id", "left").groupBy(F.col(S.TARGET).alias("label")).agg(
        F.count(F.lit(1)).alias("made"), F.count_if(mine).alias("on_segment")
    )
    counts = train.groupBy(F.col(S.TARGET).alias("label")).agg(F.count(F.lit(1)).alias("n_rows")).join(made, "label", "left")
    none = F.lit(0).cast("long")
    return counts.select(
        "label", "n_rows", F.coalesce("made", none).alias("n_synthetic"), (F.col("n_rows") + F.coalesce("made", none)).alias("n_after"),
        F.coalesce("on_segment", none).alias("n_on_segment"),
    )
