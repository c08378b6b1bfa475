"""Distributed prefix sums: ranks and cumulative counts without one big window.

A window ordered over all rows of a group runs in one task. Here rows are first
collapsed to one row per distinct value, then cut into value slices. The running
sum inside a slice is a window over (group, slice); the sums of whole slices are
a small table that gives every slice its offset. Hot values are already one row
and hot groups are spread over the slices.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions import columns as C

ROWS_PER_SLICE = 2_000_000
MAX_SLICES = 1024


def slice_edges(
    df: DataFrame,
    value: str | Column,
    slices: int | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> list[float]:
    """Cut points for balanced slices.

    They steer balance only: results are the same for any cut points. The
    sketches merge in two steps so that no single task merges those of every
    input partition.
    """
    spark = df.sparkSession
    grid_col = F.expr("array(" + ", ".join(f"{i / MAX_SLICES!r}D" for i in range(1, MAX_SLICES)) + ")")
    part = (
        df.select(C.col(value).cast("double").alias("v"), (F.spark_partition_id() % 64).alias("s"))
        .where("v is not null")
        .groupBy("s")
        .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", grid_col, 2 * MAX_SLICES).alias("q"))
    )
    row = (
        part.select("n", F.posexplode("q").alias("p", "v"))
        .agg(
            F.sum(F.when(F.col("p") == 0, F.col("n"))).alias("n"),
            F.percentile_approx("v", grid_col, 2 * MAX_SLICES).alias("q"),
        )
        .first()
    )
    if not row["n"]:
        return []
    if slices is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        slices = max(least, -(-row["n"] // rows_per_slice))
    slices = max(1, min(MAX_SLICES, slices))
    picks = [row["q"][round(i * MAX_SLICES / slices) - 1] for i in range(1, slices)]
    return sorted(set(picks))


def even_slices(cells: DataFrame, value: str, by: Sequence[str], per_slice: int) -> DataFrame:
    """Adds ``s1`` and ``s2``, numbers that follow the value, so that each (by, s1, s2) has at most ``per_slice`` rows.

    ``s1`` comes from balanced cut points, of which there is a fixed number; ``s2`` cuts each of these slices by
    row number, so that slices of any number of rows give parts of one size. Up to ``per_slice`` rows in all
    nothing is added.
    """
    n = cells.count()
    if n <= per_slice:
        return cells
    cut = cells.withColumn("s1", C.count_edges(value, slice_edges(cells, value, slices=-(-n // per_slice))).cast("int"))
    inside = Window.partitionBy(*by, "s1").orderBy(value)
    return cut.withColumn("s2", F.floor((F.row_number().over(inside) - 1) / per_slice).cast("int"))


def prefix_sums(
    cells: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    edges: Sequence[float] = (),
    keep_slice: bool = False,
) -> DataFrame:
    """Add ``<s>_below`` (total over strictly smaller values) and ``<s>_total``.

    ``cells`` has one row per (by, order); keys must not be null. The join on
    (by, slice) reuses the partitioning of the window, so only the small slice
    table moves.
    """
    by = list(by)
    cut = cells.withColumn("_slice", C.count_edges(order, edges))
    inside = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = cut.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums])
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*by, "_slice")
        .agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
        .select(
            *by, "_slice",
            *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
            *[F.sum(f"_s_{s}").over(group).alias(f"{s}_total") for s in sums],
        )
    )
    joined = run.join(offsets, [*by, "_slice"])
    return joined.select(
        *cells.columns,
        *(["_slice"] if keep_slice else []),
        *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"{s}_below") for s in sums],
        *[F.col(f"{s}_total") for s in sums],
    )


def with_group_values(
    sliced: DataFrame, by: Sequence[str], per_slice: Mapping[str, Column], combine: Mapping[str, Callable[[str], Column]]
) -> DataFrame:
    """Give every row a value of its whole group without bringing the group together.

    ``per_slice`` aggregates a (group, slice), ``combine`` turns these into the
    group's value over a table of one row per slice; the join back is on (group,
    slice), by which ``sliced`` is partitioned already.
    """
    by = list(by)
    group = Window.partitionBy(*(by or [F.lit(0)]))
    small = sliced.groupBy(*by, "_slice").agg(*[e.alias(n) for n, e in per_slice.items()])
    values = small.select(*by, "_slice", *[combine[n](n).over(group).alias(n) for n in per_slice])
    return sliced.join(values, [*by, "_slice"])


def score_cells(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, score) with the counts of positives and negatives."""
    y = F.col(label).cast("long")
    return (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    )


def cumulative_cells(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), slices: int | None = None,
    keep_slice: bool = False,
) -> DataFrame:
    """Score cells with the counts below them; the base of every rank metric."""
    edges = slice_edges(df, score, slices)
    return prefix_sums(score_cells(df, label, score, by), "score", ["pos", "neg"], by, edges, keep_slice)


def row_ranks(
    df: DataFrame, by: Sequence[str], hex_key: str, tie: str, prefix: int = 3, out: str = "rank"
) -> DataFrame:
    """0-based rank of each row in its group, ordered by (hex_key, tie).

    ``hex_key`` is a digest, so its leading digits give even slices by
    construction and no pass over the data is needed to find them.
    """
    by = list(by)
    cut = df.withColumn("_slice", F.substring(hex_key, 1, prefix))
    inside = Window.partitionBy(*by, "_slice").orderBy(hex_key, tie)
    run = cut.withColumn("_in", F.row_number().over(inside) - 1)
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *by, "_slice",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
            F.sum("_n").over(group).alias(f"{out}_total"),
        )
    )
    return run.join(offsets, [*by, "_slice"]).select(
        *df.columns, (F.col("_in") + F.col("_off")).alias(out), f"{out}_total"
    )
