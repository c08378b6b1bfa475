"""Relations between columns: correlation, collinearity, class densities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.sources.tables import stage


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, other, pos, other_pos, corr) below the diagonal, each over its
    complete pairs.

    Tasks reduce Arrow batches to features x features moment sums (values are
    shifted by the column means first, so the sums do not cancel); only those
    sums are shuffled.
    """
    m = len(features)
    narrow = df.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    means = narrow.agg(*[F.avg(f"_{i}").alias(f"m{i}") for i in range(m)]).first()
    shift = np.array([means[f"m{i}"] or 0.0 for i in range(m)])
    low = [(i, j) for i in range(m) for j in range(i)]
    fields = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fields), m, m))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            known = ~np.isnan(x)
            x, known = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([known.T @ known, x.T @ known, known.T @ x, (x * x).T @ known, known.T @ (x * x), x.T @ x])
        picked = [total[k][[i for i, _ in low], [j for _, j in low]] for k in range(len(fields))]
        pair = pa.array(range(len(low)), pa.int32())
        yield pa.RecordBatch.from_arrays([pair, *[pa.array(v) for v in picked]], names=["pair", *fields])

    schema = "pair int, " + ", ".join(f"{f} double" for f in fields)
    sums = narrow.mapInArrow(moments, schema).groupBy("pair").agg(*[F.sum(f).alias(f) for f in fields])
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    names = F.array(*[F.lit(f) for f in features])
    left, right = (F.get(F.array(*[F.lit(p[k]) for p in low]), F.col("pair")) for k in (0, 1))
    return sums.where(n > 0).select(
        F.get(names, left).alias("feature"), F.get(names, right).alias("other"), left.alias("pos"), right.alias("other_pos"),
        F.when(spread > 0, cov / F.sqrt(spread)).alias("corr"),
    )


def correlation_filter(pairs: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Columns to drop: the later one of any pair above the threshold."""
    return pairs.where(F.abs("corr") > threshold).select("feature").distinct()


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation from the diagonal of the inverse correlation matrix.

    The matrix has features x features entries, whatever the row count. A
    constant column has no inflation (null) and stays out of the matrix; a
    column that the others determine gets infinity.
    """
    m = np.eye(len(features))
    # Written once and read twice; it also keeps the planner from carrying one condition per column through every alias.
    complete = stage(df.dropna(subset=list(features)).select(*features), "complete-rows")
    known = set()
    for r in correlation_pairs(complete, features).collect():
        if r["corr"] is not None:
            m[r["pos"], r["other_pos"]] = m[r["other_pos"], r["pos"]] = r["corr"]
            known |= {r["pos"], r["other_pos"]}
    used = sorted(known)
    found = dict(zip(used, _inflation(m[np.ix_(used, used)]), strict=True))
    rows = [(f, found.get(k)) for k, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def _inflation(m: np.ndarray, tolerance: float = 1e-10) -> list[float]:
    """Diagonal of the inverse; infinity where a null direction of the matrix involves the column."""
    values, vectors = np.linalg.eigh(m)
    flat = values < tolerance
    tied = (vectors[:, flat] ** 2).sum(axis=1) > tolerance
    diagonal = (vectors[:, ~flat] ** 2 / values[~flat]).sum(axis=1)
    return [float("inf") if t else float(d) for t, d in zip(tied, diagonal, strict=True)]


def density_by_class(
    df: DataFrame, features: Sequence[str], label: str = S.TARGET, cells: int = 512, grid: int = 100
) -> DataFrame:
    """Gaussian kernel density per feature and class on an even grid.

    Rows collapse to at most ``cells`` kernels per feature and class, centred
    at the mean of their rows; the bandwidth is Scott's rule. The grid runs
    half a range beyond the data on both sides.
    """
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    parts = []
    for i, c in enumerate(features):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        step = (hi - lo) / cells if lo is not None and hi > lo else 1.0
        parts.append(f"'{c}', cast(`{c}` as double), {lo!r}D, {step!r}D" if lo is not None else f"'{c}', cast(null as double), 0D, 1D")
    rows = df.selectExpr(f"`{label}` as label", f"stack({len(features)}, {', '.join(parts)}) as (feature, v, lo, step)").where("v is not null and label is not null")
    cell = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("step")), F.lit(cells - 1))
    kernels = rows.groupBy("feature", "label", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    w = Window.partitionBy("feature", "label")
    n, s, ss = F.sum("c").over(w), F.sum("s").over(w), F.sum("ss").over(w)
    std = F.sqrt((ss - s * s / n) / (n - 1))
    ready = kernels.select(
        "feature", "label", (F.col("s") / F.col("c")).alias("m"), "c", n.alias("n"),
        (std * F.pow(n.cast("double"), F.lit(-0.2))).alias("h"), F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"),
    )
    span = F.col("hi") - F.col("lo")
    x = F.col("lo") - span * 0.5 + F.col("k") * (span * 2.0 / (grid - 1))
    z = (F.col("x") - F.col("m")) / F.col("h")
    weight = F.col("c") * F.exp(z * z * -0.5) / (F.col("n") * F.col("h") * math.sqrt(2.0 * math.pi))
    return (
        ready.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("x", x)
        .groupBy("feature", "label", "k").agg(F.first("x").alias("x"), F.sum(weight).alias("density"))
    )
