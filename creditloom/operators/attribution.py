"""Feature attribution: contributions per row and the tables built from them.

A contribution frame is wide: id, the feature columns, one ``phi__<feature>``
column each and ``base``. Per-row reports need no shuffle; per-feature reports
stack the columns and aggregate map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom import schema as S


def phi(feature: str) -> str:
    return f"phi__{feature}"


def features_of(contrib: DataFrame) -> list[str]:
    return [c[5:] for c in contrib.columns if c.startswith("phi__")]


def attribution_linear(df: DataFrame, coefficients: Mapping[str, float], intercept: float = 0.0, key: str = S.ID) -> DataFrame:
    """Exact contributions of a linear model: coef * (x - mean of x)."""
    names = list(coefficients)
    row = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(names)]).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(names))]
    base = intercept + sum(coefficients[f] * m for f, m in zip(names, means))
    terms = [((F.col(f) - F.lit(m)) * float(coefficients[f])).alias(phi(f)) for f, m in zip(names, means)]
    return df.select(key, *names, *terms, F.lit(float(base)).alias("base"))


def long_form(contrib: DataFrame, key: str = S.ID, features: Sequence[str] | None = None, values: bool = True) -> DataFrame:
    """(id, feature, value, phi), or without the value."""
    names = list(features) if features is not None else features_of(contrib)
    if not values:
        parts = ", ".join(f"'{f}', `{phi(f)}`" for f in names)
        return contrib.selectExpr(f"`{key}`", f"stack({len(names)}, {parts}) as (feature, phi)")
    parts = ", ".join(f"'{f}', cast(`{f}` as double), `{phi(f)}`" for f in names)
    return contrib.selectExpr(f"`{key}`", f"stack({len(names)}, {parts}) as (feature, value, phi)")


def mean_abs(contrib: DataFrame) -> DataFrame:
    """(feature, mean_abs_shap), descending."""
    names = features_of(contrib)
    parts = ", ".join(f"'{f}', m{i}" for i, f in enumerate(names))
    means = contrib.agg(*[F.avg(F.abs(phi(f))).alias(f"m{i}") for i, f in enumerate(names)])
    return means.selectExpr(f"stack({len(names)}, {parts}) as (feature, mean_abs_shap)").orderBy(F.desc("mean_abs_shap"), "feature")


def prune_list(importance: DataFrame, threshold: float = 0.001) -> DataFrame:
    return importance.where(F.col("mean_abs_shap") < threshold).select("feature")


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    top = importance.orderBy(F.desc("mean_abs_shap"), "feature").limit(n)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs_shap"), "feature")
    return top.select("feature", "mean_abs_shap", F.row_number().over(order).alias("rank"))


def _prefixed(prefixes: Sequence[str]) -> Column:
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col("feature").startswith(p)
    return test


def group_by_prefix(importance: DataFrame, prefixes: Mapping[str, Sequence[str]] = S.PREFIXES) -> DataFrame:
    """One row: sum per group (4 places) and percent of the total (1 place).

    The total includes features that match no group.
    """
    v = F.col("mean_abs_shap")
    sums = {g: F.sum(F.when(_prefixed(p), v).otherwise(0.0)) for g, p in prefixes.items()}
    row = importance.agg(*[s.alias(f"_{g}") for g, s in sums.items()], F.sum(v).alias("_total"))
    return row.select(
        *[F.bround(f"_{g}", 4).alias(f"{g}_mean_abs_shap") for g in prefixes],
        F.bround("_total", 4).alias("total_mean_abs_shap"),
        *[F.bround(F.try_divide(F.col(f"_{g}"), F.col("_total")) * 100.0, 1).alias(f"{g}_pct") for g in prefixes],
    )


def group_by_map(importance: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(group, total_abs_shap, pct_contribution) by explicit lists, descending."""
    v = F.col("mean_abs_shap")
    row = importance.agg(
        F.sum(v).alias("_total"), *[F.sum(F.when(F.col("feature").isin(list(f)), v).otherwise(0.0)).alias(f"_g{i}") for i, f in enumerate(groups.values())]
    )
    parts = ", ".join(f"'{g}', _g{i}" for i, g in enumerate(groups))
    return (
        row.selectExpr("_total", f"stack({len(groups)}, {parts}) as (`group`, total_abs_shap)")
        .select("group", "total_abs_shap", F.bround(F.try_divide(F.col("total_abs_shap"), F.col("_total")) * 100.0, 2).alias("pct_contribution"))
        .orderBy(F.desc("pct_contribution"), "group")
    )


def bureau_vs_rest(importance: DataFrame, prefix: str = "cic_") -> DataFrame:
    v, is_bureau = F.col("mean_abs_shap"), F.col("feature").startswith(prefix)
    row = importance.agg(F.sum(F.when(is_bureau, v).otherwise(0.0)).alias("b"), F.sum(F.when(~is_bureau, v).otherwise(0.0)).alias("r"))
    total = F.col("b") + F.col("r") + 1e-9
    return row.select((F.col("b") / total * 100.0).alias("bureau_pct"), (F.col("r") / total * 100.0).alias("rest_pct"))


def beeswarm_points(contrib: DataFrame, top: int = 20, key: str = S.ID) -> DataFrame:
    """(id, feature, value, phi) of the strongest features; value and phi share a row already."""
    names = [r["feature"] for r in top_features(mean_abs(contrib), top).collect()]
    return long_form(contrib, key, names)


def dependence_points(contrib: DataFrame, feature: str, other: str = "auto", key: str = S.ID) -> DataFrame:
    """(id, value, phi, interaction, interaction_value) of one feature.

    "auto" takes the other feature most correlated with the contribution, the
    first by name among equals.
    """
    if other == "auto":
        rest = sorted(f for f in features_of(contrib) if f != feature)
        row = contrib.agg(*[F.abs(F.corr(F.col(f).cast("double"), F.col(phi(feature)))).alias(f"c{i}") for i, f in enumerate(rest)]).first()
        strength = [row[f"c{i}"] if row[f"c{i}"] is not None else -1.0 for i in range(len(rest))]
        other = rest[max(range(len(rest)), key=lambda i: strength[i])]
    return contrib.select(
        key, F.col(feature).cast("double").alias("value"), F.col(phi(feature)).alias("phi"),
        F.lit(other).alias("interaction"), F.col(other).cast("double").alias("interaction_value"),
    )


def waterfall_row(contrib: DataFrame, key_value: object, n: int = 15, key: str = S.ID) -> DataFrame:
    """One row's contributions by size, with the base value."""
    one = contrib.where(F.col(key) == F.lit(key_value))
    rows = one.selectExpr(
        f"`{key}`", "base",
        f"stack({len(features_of(contrib))}, " + ", ".join(f"'{f}', cast(`{f}` as double), `{phi(f)}`" for f in features_of(contrib)) + ") as (feature, value, phi)",
    )
    return rows.orderBy(F.desc(F.abs("phi")), "feature").limit(n)


def adverse_actions(contrib: DataFrame, n: int = 3, key: str = S.ID) -> DataFrame:
    """(id, rank, feature, phi): the features that push risk up most; no shuffle."""
    items = F.array(*[F.struct((-F.col(phi(f))).alias("neg"), F.lit(f).alias("feature")) for f in features_of(contrib)])
    top = F.slice(F.array_sort(items), 1, n)
    return contrib.select(key, F.posexplode(top).alias("pos", "item")).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("item.feature").alias("feature"), (-F.col("item.neg")).alias("phi")
    )
