"""Cleaning: fitted on training rows, applied to any rows as literal columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators.quantiles import quantiles
from creditloom.operators.ranking import row_ranks
from creditloom.operators.state import Savable, get_options, get_parameters, put_options, put_parameters
from creditloom.sources.tables import stage

LITERAL_CATEGORIES = 1000
LITERAL_FOLDS = 500
#: A key with this share of the rows is hot (so there are few), and is spread over so many parts.
HOT_SHARE = 1 / 64
SALTS = 32


def dedupe(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by ``order``.

    The rank filter is applied per input partition before the shuffle
    (WindowGroupLimit in the plan), so each task sends one row per key and the
    copies of a hot key never meet.
    """
    keys = [key] if isinstance(key, str) else list(key)
    first = Window.partitionBy(*keys).orderBy(*[C.col(o) for o in order])
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def clip_columns(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]] = S.CLIP_BOUNDS) -> DataFrame:
    present = {c: C.clip(F.col(c).cast("double"), *b) for c, b in bounds.items() if c in df.columns}
    return df.withColumns(present)


def winsor_bounds(
    train: DataFrame, features: Sequence[str], lo: float = 0.01, hi: float = 0.99, mode: str = "exact"
) -> dict[str, tuple[float, float]]:
    """Clip bounds from training percentiles; feed them to ``clip_columns``."""
    return {f: (q[0], q[1]) for f, q in quantiles(train, features, [lo, hi], mode).items() if q}


def add_missing_flags(df: DataFrame, features: Sequence[str] = S.BUREAU) -> DataFrame:
    return df.withColumns({f"{f}_missing": F.col(f).isNull().cast("int") for f in features if f in df.columns})


def missing_count(features: Sequence[str] = S.BUREAU) -> Column:
    total = F.lit(0)
    for f in features:
        total = total + F.col(f).isNull().cast("int")
    return total.alias("cic_missing_count")


def fit_medians(train: DataFrame, features: Sequence[str], mode: str = "exact") -> dict[str, float]:
    return {f: q[0] for f, q in quantiles(train, features, [0.5], mode).items() if q}


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def fit_policy(
    train: DataFrame, zero: Sequence[str] = (), median: Sequence[str] = (), mode: Sequence[str] = ()
) -> dict[str, object]:
    """Fill value per column: counts 0, ratios median, categories most frequent.

    The most frequent category is counted by (column, category) and the
    smallest name wins a tie.
    """
    values: dict[str, object] = dict.fromkeys(zero, 0.0)
    values.update(fit_medians(train, median))
    if mode:
        parts = ", ".join(f"'{c}', cast(`{c}` as string)" for c in mode)
        counts = (
            train.selectExpr(f"stack({len(mode)}, {parts}) as (c, v)").where("v is not null")
            .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("c").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), "v")).alias("v"))
        )
        values.update({r["c"]: r["v"] for r in counts.collect()})
    return values


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(category, code): rank in lexicographic order, null counted as 'nan'."""
    names = df.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("category")).distinct()
    keyed = names.withColumn("_k", F.hex(F.encode("category", "UTF-8")))
    return row_ranks(keyed, [], "_k", "category", prefix=4, out="code").select("category", F.col("code").cast("int"))


def hot_keys(df: DataFrame, key: Column) -> list[str | None]:
    """Keys (as text) that hold ``HOT_SHARE`` of the rows or more: at most 1 / ``HOT_SHARE`` of them."""
    counts = stage(df.groupBy(key.cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r["k"] for r in counts.where(F.col("n") >= total * HOT_SHARE).collect()] if total else []


def spread_join(df: DataFrame, key: Column, table: DataFrame, table_key: str, more: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """Left join of rows with a table of one row per key, where hot keys are dealt over ``SALTS`` parts.

    Keys match as null-safe equals. ``more`` are further (row column, table column) pairs. Only the table's rows of hot keys are repeated.
    """
    hot = hot_keys(df, key)
    named = [k for k in hot if k is not None]

    def is_hot(c: Column) -> Column:
        known = c.cast("string").isin(*named) if named else F.lit(False)
        return F.coalesce(known, F.lit(None in hot))

    part = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    rows = df.withColumns({"_key": key, "_salt": F.when(is_hot(key), part).otherwise(0)})
    salts = F.when(is_hot(F.col(table_key)), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    side = table.withColumn("_part", F.explode(salts))
    on = F.col("_key").eqNullSafe(F.col(table_key)) & (F.col("_salt") == F.col("_part"))
    for row, other in more:
        on = on & (row == F.col(other))
    return rows.join(side, on, "left").drop("_key", "_salt", "_part")


def label_encode(df: DataFrame, column: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """Replace categories by codes; unseen ones get 0.

    A short code table becomes a literal map; a longer one is joined, with hot
    categories spread over several parts.
    """
    out = out or f"{column}_encoded"
    seen = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    head = codes.limit(LITERAL_CATEGORIES + 1).collect()
    if len(head) <= LITERAL_CATEGORIES:
        pairs = [x for r in head for x in (F.lit(r["category"]), F.lit(r["code"]))]
        code = F.try_element_at(F.create_map(*pairs), seen) if pairs else F.lit(None).cast("int")
        return df.withColumn(out, F.coalesce(code, F.lit(0)))
    side = codes.select(F.col("category").alias("_cat"), F.col("code").alias("_code"))
    return spread_join(df, seen, side, "_cat").withColumn(out, F.coalesce("_code", F.lit(0))).drop("_cat", "_code")


def fold_of(k: int, seed: int = S.SEED, key: str = S.ID) -> Column:
    """Stateless fold number by digest; no shuffle, stable when rows are added."""
    cuts = [C.hex_threshold(i / k) for i in range(1, k)]
    digest = C.hash_hex(seed, F.lit("fold"), key)
    fold = F.lit(0)
    for c in cuts:
        fold = fold + (digest >= F.lit(c)).cast("int")
    return fold


def target_encode_oof(
    df: DataFrame, column: str, label: str = S.TARGET, k: int = 5, seed: int = S.SEED, key: str = S.ID
) -> DataFrame:
    """Mean label of the category over the other folds (all folds if alone)."""
    rows = df.withColumn("fold", fold_of(k, seed, key))
    parts = rows.groupBy(column, "fold").agg(F.sum(F.col(label).cast("long")).alias("_s"), F.count(label).alias("_n"))
    cat = Window.partitionBy(column)
    table = parts.select(
        F.col(column).alias("_c"), F.col("fold").alias("_f"),
        (F.sum("_s").over(cat) - F.col("_s")).alias("_so"), (F.sum("_n").over(cat) - F.col("_n")).alias("_no"),
    )
    # The overall mean is one row: the sums per (category, fold) added up.
    overall = parts.agg((F.sum("_s") / F.sum("_n")).alias("m")).first()["m"]
    # A short table becomes a literal map, so that the rows need no shuffle; both ways give the same values.
    head = table.limit(LITERAL_FOLDS + 1).collect()
    if len(head) <= LITERAL_FOLDS:
        mark = lambda c, f: F.concat_ws("|", f, F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")))
        means = [(r["_c"], r["_f"], r["_so"] / r["_no"]) for r in head if r["_no"]]
        known = [x for c, f, m in means for x in (mark(F.lit(c).cast(df.schema[column].dataType), F.lit(f)), F.lit(m))]
        mean = F.try_element_at(F.create_map(*known), mark(F.col(column), F.col("fold"))) if known else F.lit(None).cast("double")
        return rows.withColumn(f"{column}_te", F.coalesce(mean, F.lit(overall)))
    enc = F.coalesce(F.try_divide("_so", "_no"), F.lit(overall))
    joined = spread_join(rows, F.col(column), table, "_c", [(F.col("fold"), "_f")])
    return joined.withColumn(f"{column}_te", enc).drop("_c", "_f", "_so", "_no")


def fit_scale(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, one aggregation; 0 spread gives 1."""
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}")]
    row = train.agg(*aggs).first()
    return {f: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, f in enumerate(features) if row[f"m{i}"] is not None}


def scaled(fitted: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    return {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()}


def scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(scaled(fitted))


class CreditCleaner(Estimator):
    """encode -> clip -> flag -> impute -> [scale], as a pipeline stage."""

    def __init__(
        self,
        numeric: Sequence[str] = tuple(S.CLEANER_NUMERIC),
        bureau: Sequence[str] = tuple(S.BUREAU),
        categorical: Sequence[str] = tuple(S.CATEGORICAL),
        bounds: Mapping[str, tuple[float, float]] | None = None,
        label: str = S.TARGET,
        apply_scaling: bool = False,
        keep_label: bool = False,
        keep_encoded: bool = False,
        median_mode: str = "exact",
    ):
        super().__init__()
        self.options = dict(
            numeric=list(numeric), bureau=list(bureau), categorical=list(categorical),
            bounds=dict(S.CLIP_BOUNDS if bounds is None else bounds), label=label,
            keep_label=keep_label, keep_encoded=keep_encoded,
        )
        self.apply_scaling = apply_scaling
        self.median_mode = median_mode

    def _fit(self, dataset: DataFrame) -> CreditCleanerModel:
        o = self.options
        numeric = [c for c in o["numeric"] if c in dataset.columns]
        clipped = clip_columns(dataset.select(*[F.col(c).cast("double").alias(c) for c in numeric]), o["bounds"])
        medians = fit_medians(clipped, numeric, self.median_mode)
        scaling = None
        if self.apply_scaling:
            ready = add_missing_flags(clipped, o["bureau"])
            flags = [f"{c}_missing" for c in o["bureau"] if c in numeric]
            scaling = fit_scale(fill(ready, medians), [*numeric, *flags])
        codes = {c: stage(category_codes(dataset, c), f"codes-{c}") for c in o["categorical"] if c in dataset.columns}
        return CreditCleanerModel({**o, "numeric": numeric}, medians, codes, scaling)


class CreditCleanerModel(Savable, Model):
    def __init__(self, options: dict, medians: dict[str, float], codes: dict[str, DataFrame], scaling: dict | None):
        super().__init__()
        self.options, self.medians, self.codes, self.scaling = options, medians, codes, scaling

    def save_state(self, spark: SparkSession, path: str) -> None:
        put_options(spark, path, "cleaner", {**self.options, "coded": list(self.codes), "scaled": self.scaling is not None})
        put_parameters(spark, path, {"median": {c: [v] for c, v in self.medians.items()}, "scale": self.scaling or {}})
        for c, codes in self.codes.items():
            codes.write.parquet(f"{path}/codes/{c}")

    @classmethod
    def load_state(cls, spark: SparkSession, path: str) -> CreditCleanerModel:
        _, options = get_options(spark, path, "cleaner")
        found = get_parameters(spark, path)
        coded, scaled = options.pop("coded"), options.pop("scaled")
        scaling = {c: tuple(v) for c, v in found.get("scale", {}).items()} if scaled else None
        return cls(
            options, {c: v[0] for c, v in found.get("median", {}).items()},
            {c: spark.read.parquet(f"{path}/codes/{c}") for c in coded}, scaling,
        )

    @property
    def feature_names(self) -> list[str]:
        o = self.options
        flags = [f"{c}_missing" for c in o["bureau"] if c in o["numeric"]]
        encoded = [f"{c}_encoded" for c in self.codes] if o["keep_encoded"] else []
        return [*o["numeric"], *flags, *encoded]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        o = self.options
        df = dataset.withColumns({c: F.col(c).cast("double") for c in o["numeric"]})
        if o["keep_encoded"]:
            for c, codes in self.codes.items():
                df = label_encode(df, c, codes)
        df = add_missing_flags(clip_columns(df, {c: b for c, b in o["bounds"].items() if c in o["numeric"]}), [c for c in o["bureau"] if c in o["numeric"]])
        df = fill(df, self.medians)
        if self.scaling:
            df = scale(df, self.scaling)
        dropped = {*o["categorical"]} | (set() if o["keep_label"] else {o["label"]})
        extra = [c for c in dataset.columns if c not in self.feature_names and c not in dropped]
        return df.select(*self.feature_names, *extra)


def describe_missing(df: DataFrame) -> DataFrame:
    """Columns with missing values: count, percent, type; one aggregation."""
    types = dict(df.dtypes)
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"_m{i}") for i, c in enumerate(df.columns)],
    )
    parts = ", ".join(f"'{c}', _m{i}, '{types[c]}'" for i, c in enumerate(df.columns))
    pct = F.bround(F.col("n_missing") / F.col("_n") * 100.0, 2)
    return (
        counts.selectExpr("_n", f"stack({len(df.columns)}, {parts}) as (column, n_missing, dtype)")
        .where("n_missing > 0")
        .select("column", "n_missing", pct.alias("pct_missing"), "dtype")
        .orderBy(F.desc("pct_missing"), "column")
    )


def missing_profile(df: DataFrame) -> DataFrame:
    severity = F.when(F.col("pct_missing") > 30, "high").when(F.col("pct_missing") > 10, "medium").otherwise("low")
    return describe_missing(df).select("column", "pct_missing", severity.alias("severity"))


def range_check(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None, float]] = S.VALID_RANGES) -> DataFrame:
    """Out-of-range and missing counts per declared column; one aggregation."""
    cols = [c for c in ranges if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        lo, hi, _ = ranges[c]
        x = F.col(c)
        out = (x < F.lit(lo)) if lo is not None else F.lit(False)
        if hi is not None:
            out = out | (x > F.lit(hi))
        aggs += [
            F.sum(F.coalesce(out, F.lit(False)).cast("long")).alias(f"_o{i}"),
            F.sum(x.isNull().cast("long")).alias(f"_m{i}"),
        ]
    parts = ", ".join(f"'{c}', _o{i}, _m{i}, double({ranges[c][2]})" for i, c in enumerate(cols))
    share = F.col("n_missing") / F.col("_n")
    return (
        df.agg(*aggs).selectExpr("_n", f"stack({len(cols)}, {parts}) as (column, n_out_of_range, n_missing, expected_missing)")
        .select(
            "column", "n_out_of_range", "n_missing", F.round(share, 6).alias("missing_rate"),
            (share > F.col("expected_missing")).alias("above_expected"),
        )
    )


def class_distribution(df: DataFrame, label: str = S.TARGET) -> DataFrame:
    n = F.col("n_rows")
    return (
        df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("pct", n / F.sum(n).over(Window.partitionBy(F.lit(0))) * 100.0)
    )
