"""Quantile binning, weight of evidence and information value.

All features are binned and counted in one job: bin ids are literal
comparisons, one ``stack`` makes (feature, bin, label) rows and map-side
partial aggregation leaves features x bins rows to shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators.quantiles import distinct_edges, quantiles
from creditloom.operators.state import Savable, get_options, get_parameters, put_options, put_parameters


def quantile_edges(
    df: DataFrame, features: Sequence[str], n_bins: int = 10, label: str | None = None, mode: str = "exact"
) -> dict[str, list[float]]:
    """Distinct equal-frequency edges per feature, over rows whose label is known."""
    known = F.col(label).isNotNull() if label else F.lit(True)
    cols = {f: F.when(known, F.col(f)) for f in features}
    return {f: distinct_edges(v) for f, v in quantiles(df, cols, C.linspace(0.0, 1.0, n_bins), mode).items()}


def equal_width_edges(df: DataFrame, features: Sequence[str], n_bins: int = 10) -> dict[str, list[float]]:
    """Evenly spaced edges from minimum to maximum; one aggregation for all features."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in features:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if lo is None:
            out[c] = []
            continue
        if lo == hi:
            pad = 0.001 * abs(lo) or 0.001
            lo, hi = lo - pad, hi + pad
        out[c] = C.linspace(lo, hi, n_bins)
    return out


def bin_id(feature: str | Column, edges: Sequence[float]) -> Column:
    """Right-closed bin number from 0; values outside the edges join the end bins."""
    return C.count_edges(feature, edges[1:-1])


def bin_rows(df: DataFrame, bins: Mapping[str, Column], label: str) -> DataFrame:
    """Long (feature, bin, y) rows."""
    names = list(bins)
    wide = df.select(F.col(label).cast("long").alias("_y"), *[bins[f].alias(f"_b{i}") for i, f in enumerate(names)])
    parts = ", ".join("'" + f.replace("'", "\\'") + f"', _b{i}" for i, f in enumerate(names))
    return wide.selectExpr("_y as y", f"stack({len(names)}, {parts}) as (feature, bin)")


def bin_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], label: str) -> DataFrame:
    """(feature, bin, n, n_events); bin is null where the feature is missing.

    Values are stacked first and each row looks its edges up by feature number,
    which keeps the generated code small however many features there are.
    """
    usable = {f: e for f, e in edges.items() if len(e) > 1}
    if not usable:
        schema = "feature string, bin int, n long, n_events long"
        return df.sparkSession.createDataFrame([], schema)
    names = list(usable)
    width = max(len(e) for e in usable.values()) - 2
    table = F.array(*[
        F.array(*[F.lit(float(x)) for x in [*usable[f][1:-1], *[float("inf")] * (width + 2 - len(usable[f]))]]).cast("array<double>")
        for f in names
    ])
    values = [F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(names)]
    parts = ", ".join(f"{i}, _v{i}" for i in range(len(names)))
    rows = (
        df.where(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("y"), *values)
        .selectExpr("y", f"stack({len(names)}, {parts}) as (f, v)")
        .withColumn("_e", F.get(table, F.col("f")))
    )
    bin_no = F.when(F.col("v").isNotNull(), F.lit(0))
    for k in range(width):
        bin_no = bin_no + (F.col("v") > F.get("_e", F.lit(k))).cast("int")
    counted = rows.groupBy("f", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_events"))
    label_of = F.get(F.array(*[F.lit(f) for f in names]), F.col("f"))
    return counted.select(label_of.alias("feature"), "bin", "n", "n_events")


def evidence(counts: DataFrame, smoothing: str = "floor") -> DataFrame:
    """Weight of evidence and IV share of each (feature, bin) count row.

    ``floor``: complete rows only, shares floored at 1e-8, totals at 1.
    ``additive``: totals over all rows including missing values, 1e-6 added to
    counts and totals.
    """
    per_feature = Window.partitionBy("feature")
    if smoothing == "floor":
        counts = counts.where("bin is not null")
    rows = counts.select(
        "feature", "bin", "n_events", (F.col("n") - F.col("n_events")).alias("n_non_events")
    ).select(
        "*",
        F.sum("n_events").over(per_feature).alias("_te"),
        F.sum("n_non_events").over(per_feature).alias("_tn"),
    ).where("bin is not null")

    def share(count: str, total: str) -> Column:
        c, t = F.col(count).cast("double"), F.col(total).cast("double")
        if smoothing == "floor":
            return F.greatest(c / F.greatest(t, F.lit(1.0)), F.lit(1e-8))
        return (c + F.lit(1e-6)) / (t + F.lit(1e-6))

    return (
        rows.withColumn("dist_events", share("n_events", "_te"))
        .withColumn("dist_non_events", share("n_non_events", "_tn"))
        .withColumn("woe", F.ln(F.col("dist_events") / F.col("dist_non_events")))
        .withColumn("iv", (F.col("dist_events") - F.col("dist_non_events")) * F.col("woe"))
        .drop("_te", "_tn")
    )


def woe_iv_table(
    df: DataFrame, features: Sequence[str], label: str = S.TARGET, n_bins: int = 10, mode: str = "exact",
    width: bool = False,
) -> DataFrame:
    """Bin-level table of every feature; a constant feature has no rows.

    ``width`` takes evenly spaced instead of equal-frequency bins.
    """
    if width:
        edges = {f: e for f, e in equal_width_edges(df, features, n_bins).items() if e}
    else:
        edges = quantile_edges(df, features, n_bins, label, mode)
    return evidence(bin_counts(df, edges, label))


def iv_totals(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, iv) with 0 for features that have no bins."""
    spark = table.sparkSession
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    got = table.groupBy("feature").agg(F.sum("iv").alias("iv"))
    return names.join(got, "feature", "left").select("feature", F.coalesce("iv", F.lit(0.0)).alias("iv"))


def merge_small_bins(counts: DataFrame, min_size: int) -> DataFrame:
    """Join each bin below ``min_size`` rows to its smaller neighbour.

    Runs on the count table: at most one row per bin and feature in a group.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("bin").to_dict("records")
        for r in rows:
            r["last_bin"] = r["bin"]
        while len(rows) > 1 and min(r["n"] for r in rows) < min_size:
            i = min(range(len(rows)), key=lambda k: rows[k]["n"])
            near = [k for k in (i - 1, i + 1) if 0 <= k < len(rows)]
            a, b = sorted((i, min(near, key=lambda k: rows[k]["n"])))
            rows[a]["n"] += rows[b]["n"]
            rows[a]["n_events"] += rows[b]["n_events"]
            rows[a]["last_bin"] = rows[b]["last_bin"]
            del rows[b]
        return pd.DataFrame(rows)[["feature", "bin", "last_bin", "n", "n_events"]]

    schema = "feature string, bin int, last_bin int, n long, n_events long"
    return counts.where("bin is not null").groupBy("feature").applyInPandas(merge, schema)


def default_rate_by_bin(
    df: DataFrame, features: Sequence[str], label: str = S.TARGET, n_bins: int = 10
) -> DataFrame:
    counts = bin_counts(df, quantile_edges(df, features, n_bins, label), label).where("bin is not null")
    rate = F.col("n_events") / F.col("n") * 100.0
    return counts.select("feature", "bin", rate.alias("default_rate_pct"), F.col("n").alias("n_obs"))


def iv_by_group(totals: DataFrame, bureau: Sequence[str] = S.BUREAU, behavioural: Sequence[str] = S.BEHAVIOURAL) -> DataFrame:
    """IV per feature, ascending, tagged by source and reference lines."""
    group = (
        F.when(F.col("feature").isin(list(bureau)), "bureau")
        .when(F.col("feature").isin(list(behavioural)), "behavioural")
        .otherwise("other")
    )
    return totals.select(
        "feature", "iv", group.alias("source"),
        (F.col("iv") >= S.IV_MIN).alias("above_minimum"), (F.col("iv") > S.IV_LEAKAGE).alias("above_leakage"),
    ).orderBy("iv", "feature")


def _numeric(df: DataFrame, features: Sequence[str]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [f for f in features if isinstance(types[f], (T.NumericType, T.BooleanType))]


def require_both_classes(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.sum(F.col(label).cast("long")).alias("e"), F.count(label).alias("n")).first()
    events, n = row["e"] or 0, row["n"]
    if events == 0 or events == n:
        raise ValueError("the label must contain both classes")
    return events, n - events


@dataclass
class WoeEncoder(Savable):
    """Fitted bins and weights; ``transform`` needs no shuffle and no join."""

    n_bins: int = 10
    iv_threshold: float = S.IV_MIN
    min_bin_share: float | None = None
    edges: dict[str, list[float]] | None = None
    table: DataFrame | None = None
    weights: dict[str, dict[int, float]] | None = None
    iv: dict[str, float] | None = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str = S.TARGET) -> WoeEncoder:
        events, non_events = require_both_classes(df, label)
        usable = _numeric(df, features)
        for skipped in set(features) - set(usable):
            warnings.warn(f"skipped non-numeric column {skipped!r}", stacklevel=2)
        # Edges use every value, also where the label is unknown.
        self.edges = quantile_edges(df, usable, self.n_bins)
        for f in [f for f, e in self.edges.items() if len(e) < 2]:
            warnings.warn(f"skipped column without spread {f!r}", stacklevel=2)
        counts = bin_counts(df, self.edges, label)
        if self.min_bin_share:
            merged = merge_small_bins(counts, int(self.min_bin_share * (events + non_events)))
            self._drop_edges(merged)
            counts = bin_counts(df, self.edges, label)
        self.table = evidence(counts, "additive")
        self.weights, self.iv = {}, {}
        for r in self.table.collect():  # features x bins rows
            self.weights.setdefault(r["feature"], {})[r["bin"]] = r["woe"]
            self.iv[r["feature"]] = self.iv.get(r["feature"], 0.0) + r["iv"]
        return self

    def _drop_edges(self, merged: DataFrame) -> None:
        kept: dict[str, list[float]] = {}
        for r in merged.orderBy("feature", "last_bin").collect():
            full = self.edges[r["feature"]]
            kept.setdefault(r["feature"], [full[0]]).append(full[r["last_bin"] + 1])
        for f, e in kept.items():
            self.edges[f] = e if e[-1] == self.edges[f][-1] else [*e[:-1], self.edges[f][-1]]

    def _check(self) -> None:
        if self.weights is None:
            raise RuntimeError("encoder is not fitted")

    @property
    def selected(self) -> list[str]:
        self._check()
        return [f for f, v in self.iv.items() if v >= self.iv_threshold]

    def transform(self, df: DataFrame, keep: Sequence[str] = (S.ID, S.TARGET)) -> DataFrame:
        self._check()
        out = []
        for f in sorted(self.selected):
            if f not in df.columns:
                warnings.warn(f"column {f!r} is absent", stacklevel=2)
                continue
            size = len(self.edges[f]) - 1
            lookup = F.array(*[F.lit(float(self.weights[f].get(b, 0.0))) for b in range(size)])
            woe = F.get(lookup, bin_id(F.col(f).cast("double"), self.edges[f]))
            out.append(F.coalesce(woe, F.lit(0.0)).alias(f"{f}_woe"))
        return df.select(*[c for c in keep if c in df.columns], *out)

    def save_state(self, spark: SparkSession, path: str) -> None:
        self._check()
        put_options(spark, path, "woe", {"n_bins": self.n_bins, "iv_threshold": self.iv_threshold, "min_bin_share": self.min_bin_share, "order": list(self.iv)})
        weights = {f: [x for b, w in sorted(by.items()) for x in (b, w)] for f, by in self.weights.items()}
        put_parameters(spark, path, {"edges": self.edges, "weights": weights, "iv": {f: [v] for f, v in self.iv.items()}})
        self.table.write.parquet(f"{path}/table")

    @classmethod
    def load_state(cls, spark: SparkSession, path: str) -> WoeEncoder:
        _, o = get_options(spark, path, "woe")
        found = get_parameters(spark, path)
        weights = {f: {int(b): w for b, w in zip(v[::2], v[1::2], strict=True)} for f, v in found.get("weights", {}).items()}
        return cls(
            o["n_bins"], o["iv_threshold"], o["min_bin_share"], found.get("edges", {}), spark.read.parquet(f"{path}/table"),
            {f: weights[f] for f in o["order"]}, {f: found["iv"][f][0] for f in o["order"]},
        )

    def iv_table(self) -> DataFrame:
        self._check()
        iv = F.sum("iv")
        return (
            self.table.groupBy("feature").agg(iv.alias("_iv"))
            .select("feature", F.bround("_iv", 4).alias("iv"), C.banded("_iv", S.IV_STRENGTH).alias("strength"))
            .orderBy(F.desc("iv"), "feature")
        )


@dataclass
class IvSelector(Savable):
    """Keep the features whose IV reaches the threshold."""

    iv_threshold: float = S.IV_MIN
    flag_leakage: bool = True
    n_bins: int = 10
    summary: DataFrame | None = None
    selected: list[str] | None = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str = S.TARGET) -> IvSelector:
        totals = iv_totals(woe_iv_table(df, features, label, self.n_bins), features)
        rows = totals.collect()  # one row per feature
        if self.flag_leakage:
            for r in rows:
                if r["iv"] > S.IV_LEAKAGE:
                    warnings.warn(f"{r['feature']!r} has IV {r['iv']:.4f}: possible leakage", stacklevel=2)
        ordered = sorted(rows, key=lambda r: (-r["iv"], r["feature"]))
        spark = df.sparkSession
        self.summary = spark.createDataFrame(
            [(r["feature"], r["iv"]) for r in ordered], "feature string, iv double"
        ).withColumn("status", C.banded("iv", S.IV_STATUS)).withColumn("selected", F.col("iv") >= self.iv_threshold)
        self.selected = [r["feature"] for r in ordered if r["iv"] >= self.iv_threshold]
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        if self.selected is None:
            raise RuntimeError("selector is not fitted")
        return df.select(*keep, *self.selected)

    def fit_transform(self, df: DataFrame, features: Sequence[str], label: str = S.TARGET) -> DataFrame:
        return self.fit(df, features, label).transform(df)

    def report(self) -> DataFrame:
        if self.summary is None:
            raise RuntimeError("selector is not fitted")
        return self.summary

    def save_state(self, spark: SparkSession, path: str) -> None:
        put_options(spark, path, "iv", {"iv_threshold": self.iv_threshold, "flag_leakage": self.flag_leakage, "n_bins": self.n_bins, "selected": self.selected})
        self.report().write.parquet(f"{path}/summary")

    @classmethod
    def load_state(cls, spark: SparkSession, path: str) -> IvSelector:
        _, o = get_options(spark, path, "iv")
        return cls(o["iv_threshold"], o["flag_leakage"], o["n_bins"], spark.read.parquet(f"{path}/summary").orderBy(F.desc("iv"), "feature"), o["selected"])
