"""Calibration diagnostics: one binned aggregation, then arithmetic on bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import columns as C
from creditloom.operators.quantiles import distinct_edges, quantiles


def uniform_bin(score: str | Column, n_bins: int = 10, right_closed: bool = False) -> Column:
    """Bin number on evenly spaced edges in [0, 1]; 1.0 joins the last bin."""
    return C.count_edges(score, C.linspace(0.0, 1.0, n_bins)[1:-1], inclusive=not right_closed)


def binned(df: DataFrame, bin_no: Column, label: str, score: str, by: Sequence[str]) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(score)
    return (
        df.where(F.col(label).isNotNull() & p.isNotNull())
        .groupBy(*by, bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(p).alias("sp"), F.sum((p - y) * (p - y)).alias("se"))
    )


def calibration_summary(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",), n_bins: int = 10
) -> DataFrame:
    """Unrounded Brier parts, ECE, means per group; empty bins add nothing."""
    bins = binned(df, uniform_bin(score, n_bins), label, score, by)
    n, sy, sp = F.col("n"), F.col("sy"), F.col("sp")
    # Resolution: sum n_k (o_k - o)^2 = sum sy_k^2/n_k - (sum sy)^2 / n.
    g = bins.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.sum("sy").alias("_sy"), F.sum("sp").alias("_sp"), F.sum("se").alias("_se"),
        F.sum((sp - sy) * (sp - sy) / n).alias("_rel"), F.sum(sy * sy / n).alias("_res"), F.sum(F.abs(sy - sp)).alias("_ece"),
    )
    total = F.col("n_rows")
    rate = F.col("_sy") / total
    return g.select(
        *by, "n_rows",
        (F.col("_se") / total).alias("brier_score"),
        (F.col("_rel") / total).alias("reliability"),
        F.greatest(F.col("_res") / total - rate * rate, F.lit(0.0)).alias("resolution"),
        (rate * (1.0 - rate)).alias("uncertainty"),
        (F.col("_ece") / total).alias("ece"),
        (F.col("_sp") / total).alias("mean_predicted_pd"),
        rate.alias("observed_default_rate"),
    )


def brier_decomposition(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",), n_bins: int = 10) -> DataFrame:
    return calibration_summary(df, label, score, by, n_bins).select(*by, "brier_score", "reliability", "resolution", "uncertainty")


def expected_calibration_error(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",), n_bins: int = 10) -> DataFrame:
    return calibration_summary(df, label, score, by, n_bins).select(*by, "ece")


def brier_skill_score(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    s = calibration_summary(df, label, score, by)
    return s.select(*by, (1.0 - F.try_divide("brier_score", "uncertainty")).alias("brier_skill_score"))


def calibration_report(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",), n_bins: int = 10) -> DataFrame:
    """One row per model, 5 places (ratio 4), rounded half-even."""
    s = calibration_summary(df, label, score, by, n_bins)
    names = {
        "brier_score": "brier_score", "reliability": "reliability_error", "resolution": "resolution",
        "uncertainty": "uncertainty", "ece": "ece", "mean_predicted_pd": "mean_predicted_pd",
        "observed_default_rate": "observed_default_rate",
    }
    ratio = F.col("mean_predicted_pd") / (F.col("observed_default_rate") + 1e-9)
    return s.select(*by, *[F.bround(c, 5).alias(n) for c, n in names.items()], F.bround(ratio, 4).alias("calibration_ratio"))


def reliability_table(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",), n_bins: int = 10) -> DataFrame:
    """Non-empty right-closed uniform bins: mean prediction, observed rate, size."""
    return _curve(binned(df, uniform_bin(score, n_bins, right_closed=True), label, score, by), by)


def _curve(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    return bins.select(
        *by, "bin", (F.col("sp") / F.col("n")).alias("mean_predicted_prob"),
        (F.col("sy") / F.col("n")).alias("fraction_of_positives"), F.col("n").alias("n_samples"),
    )


def model_edges(df: DataFrame, models: Sequence[str], score: str = "score", model: str = "model", n_bins: int = 10) -> dict[str, list[float]]:
    """Equal-frequency edges of every named model in one fit."""
    cols = {m: F.when(F.col(model) == m, F.col(score)) for m in models}
    return {m: distinct_edges(v) for m, v in quantiles(df, cols, C.linspace(0.0, 1.0, n_bins)).items()}


def reliability_equal_freq(df: DataFrame, edges: Mapping[str, Sequence[float]], label: str = "label", score: str = "score", model: str = "model") -> DataFrame:
    bin_no = None
    for m, e in edges.items():
        test, value = F.col(model) == m, C.count_edges(score, e[1:-1])
        bin_no = F.when(test, value) if bin_no is None else bin_no.when(test, value)
    return _curve(binned(df.where(F.col(model).isin(list(edges))), bin_no, label, score, [model]), [model])
