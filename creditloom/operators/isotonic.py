"""Monotone regression by pooling adjacent violators, in slices that merge.

Rows collapse to one (score, weight, weighted sum) cell per distinct score. Each slice of scores
pools its own cells to blocks of rising mean; the blocks of neighbouring slices are
put together and pooled again, up a tree. Pooling may be done in any order, so the result is that of
one pass over all cells, while a task only ever holds the blocks of the slices it merges.
"""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.ranking import even_slices

#: Cells pooled in one task, and slices merged at once.
CELLS_PER_TASK = 20_000
FAN_IN = 8
_BLOCK = "lo double, hi double, weight double, total double"


def pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks (lo, hi, weight, total) with strictly rising means from blocks in any state."""
    done: list[list[float]] = []
    for lo, hi, weight, total in blocks.sort_values("lo")[["lo", "hi", "weight", "total"]].to_numpy(float).tolist():
        while done and done[-1][3] * weight >= total * done[-1][2]:
            before = done.pop()
            lo, weight, total = before[0], before[2] + weight, before[3] + total
        done.append([lo, hi, weight, total])
    return pd.DataFrame(done, columns=["lo", "hi", "weight", "total"], dtype=float)


def isotonic_blocks(
    df: DataFrame, label: str = "label", score: str = "score", weight: str | None = None, per_task: int = CELLS_PER_TASK
) -> DataFrame:
    """lo, hi, weight, total, value: the steps of the rising function of the score that fits the label best.

    Rows without score or label are left out, and so are rows without a positive weight.
    """
    return _blocks(_cells(df, label, score, weight), per_task)


def _cells(df: DataFrame, label: str, score: str, weight: str | None) -> DataFrame:
    """lo, weight, total: one row a distinct score."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(score).cast("double").alias("lo"), F.col(label).cast("double").alias("y"), w.alias("w"))
    return rows.where("y is not null and w > 0").groupBy("lo").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("total"))


def _blocks(cells: DataFrame, per_task: int) -> DataFrame:
    # Asked of the cells: asked of the rows, a score would be made once to look at it and once more to keep it.
    cells = cells.where("lo is not null and not isnan(lo)")
    cells = even_slices(cells, "lo", [], per_task).withColumn("hi", F.col("lo"))
    if "s1" not in cells.columns:
        blocks = cells.groupBy().applyInPandas(pooled, _BLOCK)
    else:
        # Parts of a slice first, then slices; the numbers of both follow the score.
        blocks = _merge(_merge(cells, ["s1"], "s2"), [], "s1")
    return blocks.withColumn("value", F.col("total") / F.col("weight"))


def _merge(blocks: DataFrame, by: list[str], part: str) -> DataFrame:
    """Pools the blocks of each ``by``, ``FAN_IN`` neighbouring parts at a time."""

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        return pooled(pdf).assign(**{c: pdf[c].iloc[0] for c in (*by, part)})

    most = blocks.agg(F.max(part)).first()[0] or 0
    schema = "".join(f"{c} int, " for c in (*by, part)) + _BLOCK
    while True:
        blocks = blocks.groupBy(*by, part).applyInPandas(pool, schema)
        if not most:
            return blocks.drop(part)
        most //= FAN_IN
        blocks = blocks.withColumn(part, F.floor(F.col(part) / FAN_IN).cast("int"))


def fit_isotonic(df: DataFrame, label: str = "y", score: str = "s", weight: str | None = None, per_task: int = CELLS_PER_TASK) -> IsotonicRegressionModel:
    """Spark's model of the blocks: constant inside a block, linear between two.

    It is fitted on the ends of the blocks, which pooling leaves as they are. The cells are held while they are
    counted, cut and pooled, so that the scores are made once.
    """
    ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("at")
    cells = _cells(df, label, score, weight).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return IsotonicRegression(featuresCol="at", labelCol="value").fit(_blocks(cells, per_task).select(ends, "value"))
    finally:
        cells.unpersist()
