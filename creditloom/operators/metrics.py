"""Discrimination metrics over (label, score[, keys]) rows.

Every metric starts from the same cumulative score cells (see ``ranking``), so
any grouping keys can be added and no task ever sorts all rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators.ranking import cumulative_cells, with_group_values

POINT_METRICS = ("auc", "gini", "ks_statistic", "brier_score", "log_loss")


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def _with_rates(cells: DataFrame) -> DataFrame:
    """True/false positive counts and rates when everything >= score is flagged."""
    tp, fp = F.col("pos_total") - F.col("pos_below"), F.col("neg_total") - F.col("neg_below")
    return cells.withColumns({
        "tp": tp, "fp": fp,
        "tpr": F.try_divide(tp, F.col("pos_total")), "fpr": F.try_divide(fp, F.col("neg_total")),
    })


def _auc_sum() -> Column:
    won = _d("pos") * (_d("neg_below") + _d("neg") / 2.0)
    return F.try_divide(F.sum(won), F.max(_d("pos_total")) * F.max(_d("neg_total")))


def metrics_of_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group with the five unrounded metrics and the counts.

    With one class only the rank metrics are null.
    """
    s = F.col("score")
    n = F.max(_d("pos_total")) + F.max(_d("neg_total"))
    sq = _d("pos") * (1.0 - s) * (1.0 - s) + _d("neg") * s * s
    ll = _d("pos") * C.log_loss_term(s, True) + _d("neg") * C.log_loss_term(s, False)
    out = _with_rates(cells).groupBy(*by).agg(
        F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"),
        _auc_sum().alias("auc"),
        F.greatest(F.max(F.col("tpr") - F.col("fpr")), F.lit(0.0)).alias("ks_statistic"),
        (F.sum(sq) / n).alias("brier_score"), (F.sum(ll) / n).alias("log_loss"),
    )
    one_class = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    return out.withColumn("ks_statistic", F.when(~one_class, F.col("ks_statistic"))).withColumn("gini", F.col("auc") * 2.0 - 1.0)


def point_losses(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    """Brier score and log loss: plain means, one aggregation without any ranking."""
    y, s = F.col(label), F.col(score)
    loss = F.when(y == 1, C.log_loss_term(s, True)).otherwise(C.log_loss_term(s, False))
    return df.groupBy(*by).agg(F.avg((s - y) * (s - y)).alias("brier_score"), F.avg(loss).alias("log_loss"))


def evaluate(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    return metrics_of_cells(cumulative_cells(df, label, score, by), by)


def evaluate_model(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",),
    intervals: DataFrame | None = None,
) -> DataFrame:
    """Report rows rounded half-even to 4 places, with interval columns if given."""
    out = evaluate(df, label, score, by).select(*by, *[F.bround(m, 4).alias(m) for m in POINT_METRICS])
    if intervals is None:
        return out
    bounds = [c for c in intervals.columns if c not in by]
    return out.join(intervals.select(*by, *[F.bround(c, 4).alias(c) for c in bounds]), list(by), "left")


def compare_models(results: Sequence[DataFrame]) -> DataFrame:
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    return union.orderBy(F.desc("gini"), "model")


def roc_points(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    """Every threshold with its rates, the origin at threshold infinity, AUC and Gini."""
    cells = _with_rates(cumulative_cells(df, label, score, by, keep_slice=True))
    won = F.sum(_d("pos") * (_d("neg_below") + _d("neg") / 2.0))
    all_cells = with_group_values(cells, by, {"_won": won}, {"_won": F.sum})
    auc = F.try_divide(F.col("_won"), _d("pos_total") * _d("neg_total"))
    point = F.struct(F.col("score").alias("threshold"), "fpr", "tpr")
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    # The lowest score of a group also carries the origin.
    is_first = (F.col("pos_below") == 0) & (F.col("neg_below") == 0)
    points = F.explode(F.when(is_first, F.array(point, origin)).otherwise(F.array(point)))
    return all_cells.select(*by, points.alias("_p"), auc.alias("auc")).select(
        *by, "_p.threshold", "_p.fpr", "_p.tpr", "auc", (F.col("auc") * 2.0 - 1.0).alias("gini")
    )


def ks_curve(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    """Class distribution functions at every score, with KS and its highest threshold."""
    cells = _with_rates(cumulative_cells(df, label, score, by, keep_slice=True))
    gap = F.round(F.col("tpr") - F.col("fpr"), 12)
    best = F.max(F.struct(gap.alias("g"), F.col("score").alias("t")))
    rows = with_group_values(cells, by, {"_b": best}, {"_b": F.max})
    return rows.select(
        *by, "score",
        F.try_divide(F.col("pos_below") + F.col("pos"), F.col("pos_total")).alias("cdf_default"),
        F.try_divide(F.col("neg_below") + F.col("neg"), F.col("neg_total")).alias("cdf_non_default"),
        F.greatest(F.col("_b.g"), F.lit(0.0)).alias("ks"),
        F.when(F.col("_b.g") > 0, F.col("_b.t")).otherwise(F.lit(float("inf"))).alias("ks_threshold"),
    )


def pr_points(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    cells = _with_rates(cumulative_cells(df, label, score, by))
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    return cells.select(*by, F.col("score").alias("threshold"), precision.alias("precision"), F.col("tpr").alias("recall"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    cells = _with_rates(cumulative_cells(df, label, score, by))
    step = F.try_divide(_d("pos"), _d("pos_total")) * F.try_divide("tp", F.col("tp") + F.col("fp"))
    return cells.groupBy(*by).agg(F.sum(step).alias("average_precision"))


def cutoff_table(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",)) -> DataFrame:
    """Confusion counts and Youden index at every threshold."""
    cells = _with_rates(cumulative_cells(df, label, score, by))
    return cells.select(
        *by, F.col("score").alias("threshold"), "tp", "fp",
        F.col("pos_below").alias("fn"), F.col("neg_below").alias("tn"), (F.col("tpr") - F.col("fpr")).alias("youden"),
    )


def best_cutoff(table: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The threshold of the largest Youden index, the highest one on ties."""
    rank = F.struct(F.round("youden", 12).alias("y"), F.col("threshold").alias("t"))
    return table.groupBy(*by).agg(F.max(rank).alias("b")).select(*by, F.col("b.t").alias("threshold"), F.col("b.y").alias("youden"))


def confusion_counts(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5, by: Sequence[str] = ("model",)) -> DataFrame:
    flagged = (F.col(score) >= threshold).cast("int").alias("predicted")
    return df.groupBy(*by, label, flagged).agg(F.count(F.lit(1)).alias("n_rows"))


def score_histogram(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",), bins: int = 50) -> DataFrame:
    """Density in equal-width bins, each class over its own range.

    Scores collapse to cells and are spread over digest slices, so the range of
    a class reaches its cells without bringing the class together.
    """
    keys = [*by, label]
    cells = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    sliced = cells.withColumn("_slice", F.pmod(F.xxhash64("_s"), F.lit(256)))
    ends = {"_lo": F.min("_s"), "_hi": F.max("_s"), "_n": F.sum("_c")}
    rows = with_group_values(sliced, keys, ends, {"_lo": F.min, "_hi": F.max, "_n": F.sum})
    width = (F.col("_hi") - F.col("_lo")) / float(bins)
    slot = F.least(F.floor(F.try_divide(F.col("_s") - F.col("_lo"), width)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, F.coalesce(slot, F.lit(0)).alias("bin")).agg(
        F.sum("_c").alias("n_rows"), F.try_divide(F.sum("_c"), F.max("_n") * F.max(width)).alias("density")
    )


def metric_bars(evaluated: DataFrame, metrics: Sequence[str] = ("auc", "gini")) -> DataFrame:
    return evaluated.unpivot("model", list(metrics), "metric", "value")


def auc_lift(evaluated: DataFrame, full: str, base: str) -> DataFrame:
    auc = {m: F.max(F.when(F.col("model") == m, F.col("auc"))) for m in (full, base)}
    return evaluated.agg(auc[full].alias("auc_full"), auc[base].alias("auc_base"), (auc[full] - auc[base]).alias("auc_lift"))


def overfit_gap(df: DataFrame, label: str = "label", score: str = "score", split: str = "split", by: Sequence[str] = ("model",), limit: float = 0.02) -> DataFrame:
    parts = evaluate(df, label, score, [*by, split])
    auc = {s: F.max(F.when(F.col(split) == s, F.col("auc"))) for s in ("train", "val")}
    gap = auc["train"] - auc["val"]
    return parts.groupBy(*by).agg(
        auc["train"].alias("train_auc"), auc["val"].alias("val_auc"), gap.alias("auc_gap"), (gap < limit).alias("passed")
    )


def segment_metrics(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model", "segment")) -> DataFrame:
    return evaluate(df, label, score, by).select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n_rows"), "auc", "gini")


def acceptance_gate(evaluated: DataFrame, gate: dict[str, float] = S.GATE) -> DataFrame:
    """Bands and pass marks; a ``psi`` column takes part if present."""
    ok = (F.col("gini") >= gate["gini_min"]) & (F.col("ks_statistic") >= gate["ks_min"])
    if "psi" in evaluated.columns:
        ok = ok & (F.col("psi") <= gate["psi_max"])
    return evaluated.select(
        "*", C.banded("gini", S.GINI_BANDS).alias("gini_band"), C.banded("ks_statistic", S.KS_BANDS).alias("ks_band"), ok.alias("accepted"),
    )


def delong_test(df: DataFrame, label: str, score_a: str, score_b: str) -> DataFrame:
    """Paired test of two AUCs on the same rows: one row with z and p.

    Rows collapse to (label, score_a, score_b) counts. A row's component is its
    midrank share in the other class, read from the cumulative cells of each
    score by an equality join.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score_a).isNotNull() & F.col(score_b).isNotNull())
    joint = rows.groupBy(F.col(label).alias("y"), F.col(score_a).alias("_a"), F.col(score_b).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))

    def component(score: str, key: str, out: str) -> DataFrame:
        cells = cumulative_cells(rows, label, score)
        below = F.try_divide(_d("neg_below") + _d("neg") / 2.0, _d("neg_total"))
        above = F.try_divide(_d("pos_total") - _d("pos_below") - _d("pos") / 2.0, _d("pos_total"))
        return cells.select(F.col("score").alias(key), below.alias(f"{out}1"), above.alias(f"{out}0"))

    both = joint.join(component(score_a, "_a", "u"), "_a").join(component(score_b, "_b", "v"), "_b")
    u = F.when(F.col("y") == 1, F.col("u1")).otherwise(F.col("u0"))
    v = F.when(F.col("y") == 1, F.col("v1")).otherwise(F.col("v0"))
    c = _d("_c")
    # Components are centred at one half before squaring to keep precision.
    du, dv = u - 0.5, v - 0.5
    per_class = both.groupBy("y").agg(
        F.sum(c).alias("n"), F.sum(c * du).alias("su"), F.sum(c * dv).alias("sv"),
        F.sum(c * du * du).alias("suu"), F.sum(c * dv * dv).alias("svv"), F.sum(c * du * dv).alias("suv"),
    )

    def cov(xy: str, x: str, y: str) -> Column:
        n = F.col("n")
        return (F.col(xy) - F.col(x) * F.col(y) / n) / (n - 1.0) / n

    parts = per_class.select(
        "y", (F.col("su") / F.col("n") + 0.5).alias("ma"), (F.col("sv") / F.col("n") + 0.5).alias("mb"),
        cov("suu", "su", "su").alias("va"), cov("svv", "sv", "sv").alias("vb"), cov("suv", "su", "sv").alias("cab"),
    )
    pick = lambda col: F.max(F.when(F.col("y") == 1, F.col(col)))
    out = parts.agg(
        pick("ma").alias("auc_a"), pick("mb").alias("auc_b"),
        F.sum("va").alias("var_a"), F.sum("vb").alias("var_b"), F.sum("cab").alias("cov_ab"),
    )
    z = F.try_divide(F.col("auc_a") - F.col("auc_b"), F.sqrt(F.col("var_a") + F.col("var_b") - 2.0 * F.col("cov_ab")))
    return out.withColumn("z", z).withColumn("p_value", C.normal_two_sided_p(F.col("z")))
