"""Loading, cleaning, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.operators import cleaning as K
from creditloom.operators import splits as P
from creditloom.plans.catalog import query
from creditloom.plans.sqltext import APPS, SPLIT, clip, dbl, fold
from creditloom.sources import tables as IO
from creditloom.sources.testbed import applications, table

ID = "application_id"
NUM = [c for c in S.CLEANER_NUMERIC]


def _renamed(df):
    return (
        df.withColumn("employment_type_encoded", F.lit(0.0))
        .withColumnRenamed("declared_income_bracket", "declared_income_bracket_encoded")
        .withColumnRenamed("education_level", "education_level_encoded")
    )


@query(
    "read_table",
    "SELECT count(*) AS n_rows, round(avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END), 6) AS default_rate FROM lineitem",
)
def read_table(spark, sf):
    df = IO.read_table(spark, f"{sf}/lineitem.parquet", required=["l_orderkey", "l_returnflag"])
    df = df.withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    return IO.table_summary(df, "returned")


@query("validate_schema", APPS + "SELECT count(*) AS n_rows, round(avg(default_flag), 6) AS default_rate FROM applications")
def validate_schema(spark, sf):
    return IO.table_summary(IO.validate_schema(_renamed(applications(spark, sf))))


@query("write_table", APPS + "SELECT count(*) AS n_rows, round(sum(cic_num_delinquencies), 4) AS total_delinquencies, 'both' AS formats FROM applications")
def write_table(spark, sf):
    """Write both formats, read both back, report only if they agree."""
    import uuid

    folder = f"{IO.shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df = _renamed(applications(spark, sf)).select(S.ID, *S.REQUIRED)
    where = IO.write_table(df, folder)
    out = None
    for fmt, path in where.items():
        back = IO.read_table(spark, path).agg(
            F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("cic_num_delinquencies"), 4).alias("total_delinquencies")
        )
        out = back if out is None else out.intersect(back)
    return out.withColumn("formats", F.lit("both"))


_RANGES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce(sum(CASE WHEN {c} < {dbl(lo)}{f' OR {c} > {dbl(hi)}' if hi is not None else ''} THEN 1 ELSE 0 END), 0)::BIGINT AS n_out_of_range, "
    f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, round(avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END), 6) AS missing_rate, "
    f"avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) > {dbl(miss)} AS above_expected FROM applications"
    for c, (lo, hi, miss) in S.VALID_RANGES.items()
)


@query("range_check", APPS + _RANGES)
def range_check(spark, sf):
    return K.range_check(applications(spark, sf))


@query(
    "dedupe_applications",
    """SELECT l_orderkey, l_linenumber, l_shipdate::DATE::VARCHAR AS l_shipdate, l_partkey, round(l_extendedprice, 2) AS l_extendedprice FROM (
       SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_applications(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    out = K.dedupe(line, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.drop("l_suppkey").withColumns({
        "l_shipdate": F.to_date("l_shipdate").cast("string"), "l_extendedprice": F.round("l_extendedprice", 2),
    })


_CLIPPED = [f"round({clip(c, *b)}, 6) AS {c}" for c, b in S.CLIP_BOUNDS.items()]


@query("clip_bounds", APPS + f"SELECT application_id, {', '.join(_CLIPPED)} FROM applications")
def clip_bounds(spark, sf):
    cols = list(S.CLIP_BOUNDS)
    df = K.clip_columns(applications(spark, sf).select(ID, *cols))
    return df.select(ID, *[F.round(c, 6).alias(c) for c in cols])


_WIN = ["loan_amount_requested", *S.BUREAU, *S.BEHAVIOURAL, *S.CLEANER_DEMOGRAPHIC]


@query(
    "winsorize",
    APPS + f", tr AS (SELECT * FROM applications WHERE {SPLIT} = 'train'), b AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.01::DOUBLE) AS lo{i}, quantile_cont({c}, 0.99::DOUBLE) AS hi{i}" for i, c in enumerate(_WIN))
    + " FROM tr) SELECT application_id, "
    + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest(lo{i}, least(hi{i}, {c})) END, 4) AS {c}" for i, c in enumerate(_WIN))
    + " FROM applications, b",
)
def winsorize(spark, sf):
    df = applications(spark, sf)
    bounds = K.winsor_bounds(df.where(P.split_of() == "train"), _WIN)
    out = K.clip_columns(df.select(ID, *_WIN), bounds)
    return out.select(ID, *[F.round(c, 4).alias(c) for c in _WIN])


@query(
    "missing_flags",
    APPS + "SELECT application_id, " + ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing" for c in S.BUREAU) + " FROM applications",
)
def missing_flags(spark, sf):
    df = K.add_missing_flags(K.clip_columns(applications(spark, sf).select(ID, *S.BUREAU)))
    return df.select(ID, *[f"{c}_missing" for c in S.BUREAU])


@query(
    "missing_count",
    APPS + "SELECT application_id, " + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in S.BUREAU) + " AS cic_missing_count FROM applications",
)
def missing_count(spark, sf):
    return applications(spark, sf).select(ID, K.missing_count())


_IMP = [*S.BUREAU, "spending_volatility_90d", "education_level"]
_CL = {c: clip(c, *S.CLIP_BOUNDS[c]) if c in S.CLIP_BOUNDS else c for c in NUM}


@query(
    "impute_median",
    APPS + ", c AS (SELECT application_id, " + ", ".join(f"{_CL[c]} AS {c}" for c in _IMP) + " FROM applications)"
    + ", m AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5::DOUBLE) AS m_{c}" for c in _IMP) + f" FROM c WHERE {SPLIT} = 'train')"
    + " SELECT application_id, " + ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in _IMP) + " FROM c, m",
)
def impute_median(spark, sf):
    df = K.clip_columns(applications(spark, sf).select(ID, *_IMP))
    out = K.fill(df, K.fit_medians(df.where(P.split_of() == "train"), _IMP))
    return out.select(ID, *[F.round(c, 6).alias(c) for c in _IMP])


#: Rules of the treatment policy: counts 0, ratios and amounts the median, categories the most frequent.
_ZERO = ["cic_num_inquiries_6m", "cic_num_delinquencies", "cic_num_active_accounts", "txn_frequency_30d", "txn_frequency_90d"]
_MEDIAN = ["cic_outstanding_balance_ratio", "cic_credit_utilization", "cic_payment_history_score", "cic_account_age_months", "spending_volatility_90d", "education_level"]
_MODE = ["employment_type", "segment"]
_GAPS = {"employment_type": 7, "segment": 11}


@query(
    "impute_policy",
    APPS + f"""
, src AS (SELECT application_id, {', '.join(_ZERO + _MEDIAN)}, {', '.join(f"CASE WHEN application_id % {k} <> 0 THEN {c} END AS {c}" for c, k in _GAPS.items())}, {SPLIT} AS split FROM applications)
, m AS (SELECT {', '.join(f"quantile_cont({c}, 0.5::DOUBLE) AS m_{c}" for c in _MEDIAN)} FROM src WHERE split = 'train')
, e AS (SELECT {', '.join(f"(SELECT {c} FROM src WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top_{c}" for c in _MODE)})
SELECT application_id, {', '.join(f"coalesce({c}, 0e0) AS {c}" for c in _ZERO)}, {', '.join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in _MEDIAN)},
       {', '.join(f"coalesce({c}, top_{c}) AS {c}" for c in _MODE)} FROM src, m, e
""",
)
def impute_policy(spark, sf):
    gaps = {c: F.when(F.col(ID) % k != 0, F.col(c)) for c, k in _GAPS.items()}
    df = applications(spark, sf).select(ID, *_ZERO, *_MEDIAN, *[e.alias(c) for c, e in gaps.items()])
    values = K.fit_policy(df.where(P.split_of() == "train"), _ZERO, _MEDIAN, _MODE)
    return K.fill(df, values).withColumns({c: F.round(c, 6) for c in _MEDIAN})


@query(
    "label_encode",
    APPS + f"""
, codes AS (SELECT cat, (row_number() OVER (ORDER BY cat) - 1)::INTEGER AS code
            FROM (SELECT DISTINCT employment_type AS cat FROM applications WHERE {SPLIT} = 'train' AND employment_type <> '3-MEDIUM'))
SELECT application_id, coalesce(code, 0) AS employment_type_encoded FROM applications LEFT JOIN codes ON employment_type = cat
""",
)
def label_encode(spark, sf):
    """Fitted without one category, so that the unseen rule is exercised."""
    df = applications(spark, sf)
    train = df.where((P.split_of() == "train") & (F.col("employment_type") != "3-MEDIUM"))
    out = K.label_encode(df, "employment_type", K.category_codes(train, "employment_type"))
    return out.select(ID, "employment_type_encoded")


@query(
    "target_encode_oof",
    APPS + f"""
, r AS (SELECT application_id, employment_type, default_flag AS y, {fold(5)} AS fold FROM applications)
, p AS (SELECT employment_type, fold, sum(y)::BIGINT AS s, count(*) AS n FROM r GROUP BY ALL)
, t AS (SELECT employment_type, fold, (sum(s) OVER w - s) / (sum(n) OVER w - n)::DOUBLE AS te FROM p WINDOW w AS (PARTITION BY employment_type))
SELECT application_id, r.fold, round(te, 8) AS employment_type_te FROM r JOIN t ON r.employment_type = t.employment_type AND r.fold = t.fold
""",
)
def target_encode_oof(spark, sf):
    out = K.target_encode_oof(applications(spark, sf).select(ID, "employment_type", S.TARGET), "employment_type")
    return out.select(ID, "fold", F.round("employment_type_te", 8).alias("employment_type_te"))


@query(
    "standard_scale",
    APPS + ", st AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_WIN)) + f" FROM applications WHERE {SPLIT} = 'train') SELECT application_id, "
    + ", ".join(f"round(({c} - m{i}) / s{i}, 6) AS {c}" for i, c in enumerate(_WIN)) + " FROM applications, st",
)
def standard_scale(spark, sf):
    df = applications(spark, sf).select(ID, *_WIN)
    return K.scale(df, K.fit_scale(df.where(P.split_of() == "train"), _WIN)).select(ID, *[F.round(c, 6).alias(c) for c in _WIN])


_FLAGS = ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing" for c in S.BUREAU)


@query(
    "clean_pipeline",
    APPS + ", c AS MATERIALIZED (SELECT application_id, segment, " + ", ".join(f"{_CL[c]} AS {c}" for c in NUM) + " FROM applications)"
    + ", m AS MATERIALIZED (SELECT " + ", ".join(f"quantile_cont({c}, 0.5::DOUBLE) AS m_{c}" for c in NUM) + f" FROM c WHERE {SPLIT} = 'train')"
    + " SELECT application_id, segment, " + ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in NUM)
    + f", {_FLAGS}, {SPLIT} AS split FROM c, m",
)
def clean_pipeline(spark, sf):
    df = applications(spark, sf).select(ID, "segment", "employment_type", S.TARGET, *NUM)
    parts = P.stratified_split(df)
    model = K.CreditCleaner().fit(parts.where("split = 'train'"))
    out = model.transform(parts)
    return out.select(*[F.round(c, 6).alias(c) if c in NUM else F.col(c) for c in out.columns])


_MISSABLE = [*S.BUREAU, "spending_volatility_90d", "education_level"]
_MISSING = ", d AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, "
    f"round_even(avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100, 2) AS pct_missing, 'double' AS dtype FROM applications"
    for c in _MISSABLE
) + ")"


@query("describe_missing", APPS + _MISSING + " SELECT * FROM d WHERE n_missing > 0")
def describe_missing(spark, sf):
    return K.describe_missing(applications(spark, sf))


@query(
    "missing_profile",
    APPS + _MISSING + ' SELECT "column", pct_missing, CASE WHEN pct_missing > 30 THEN \'high\' WHEN pct_missing > 10 THEN \'medium\' ELSE \'low\' END AS severity FROM d WHERE n_missing > 0',
)
def missing_profile(spark, sf):
    return K.missing_profile(applications(spark, sf))


@query(
    "class_distribution",
    APPS + "SELECT default_flag AS label, count(*) AS n_rows, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct FROM applications GROUP BY default_flag",
)
def class_distribution(spark, sf):
    return K.class_distribution(applications(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("stratified_split", APPS + f"SELECT application_id, default_flag, {SPLIT} AS split FROM applications")
def stratified_split(spark, sf):
    return P.stratified_split(applications(spark, sf).select(ID, S.TARGET))


_RANK = "row_number() OVER (PARTITION BY default_flag ORDER BY {h}, application_id) - 1 AS r, count(*) OVER (PARTITION BY default_flag) AS n"


@query(
    "stratified_split_exact",
    APPS + ", k AS (SELECT application_id, default_flag, " + _RANK.format(h="md5(concat_ws('|', '42', application_id::VARCHAR))") + """ FROM applications)
SELECT application_id, default_flag, CASE WHEN r < floor(n * (1e0 - 0.2e0 - 0.2e0) + 0.5) THEN 'train'
       WHEN r < floor(n * (1e0 - 0.2e0) + 0.5) THEN 'val' ELSE 'test' END AS split FROM k""",
)
def stratified_split_exact(spark, sf):
    return P.stratified_split(applications(spark, sf).select(ID, S.TARGET), exact=True)


@query(
    "stratified_kfold",
    APPS + ", k AS (SELECT application_id, default_flag, " + _RANK.format(h="md5(concat_ws('|', '42', 'fold', application_id::VARCHAR))")
    + " FROM applications) SELECT application_id, default_flag, (r % 5)::INTEGER AS fold FROM k",
)
def stratified_kfold(spark, sf):
    return P.stratified_folds(applications(spark, sf).select(ID, S.TARGET))


@query(
    "class_weights",
    APPS + """
, c AS (SELECT sum(1 - default_flag)::BIGINT AS n0, sum(default_flag)::BIGINT AS n1 FROM applications)
SELECT n0, n1, round(n0 / greatest(n1, 1)::DOUBLE, 8) AS scale_pos_weight, round((n0 + n1) / (2e0 * n0), 8) AS balanced_0,
       round((n0 + n1) / (2e0 * n1), 8) AS balanced_1 FROM c
""",
)
def class_weights(spark, sf):
    t = P.class_weight_table(applications(spark, sf))
    return t.select("n0", "n1", *[F.round(c, 8).alias(c) for c in t.columns[2:]])
