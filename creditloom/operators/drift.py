"""Population stability: fixed reference bins, counts, one sum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators.quantiles import distinct_edges, quantiles

EPS = 1e-6


def reference_edges(reference: DataFrame, features: Sequence[str], n_bins: int = 10) -> dict[str, list[float]]:
    """Interior cut points from the reference rows (outer bins are open)."""
    probs = C.linspace(0.0, 1.0, n_bins)[1:-1]
    return {f: distinct_edges(q) for f, q in quantiles(reference, features, probs).items()}


def left_closed_bin(value: str | Column, cuts: Sequence[float]) -> Column:
    return C.count_edges(value, cuts, inclusive=True)


def _term(actual: Column, expected: Column) -> Column:
    a, e = actual + EPS, expected + EPS
    return (a - e) * F.ln(a / e)


def psi_per_feature(df: DataFrame, features: Sequence[str], is_actual: Column, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """(feature, psi): counts of both sides in one pass over one frame.

    A bin without rows on either side still counts, through its share of 0.
    """
    width = max(len(c) for c in cuts.values()) + 1
    wide = df.select(
        is_actual.alias("_act"),
        *[left_closed_bin(F.col(f).cast("double"), cuts[f]).alias(f"_b{i}") for i, f in enumerate(features)],
    )
    parts = ", ".join(f"'{f}', _b{i}" for i, f in enumerate(features))
    rows = wide.selectExpr("_act", f"stack({len(features)}, {parts}) as (feature, bin)").where("bin is not null and _act is not null")
    aggs = []
    for k in range(width):
        hit = F.col("bin") == k
        aggs += [
            F.sum((hit & ~F.col("_act")).cast("long")).alias(f"e{k}"),
            F.sum((hit & F.col("_act")).cast("long")).alias(f"a{k}"),
        ]
    g = rows.groupBy("feature").agg(F.sum((~F.col("_act")).cast("long")).alias("_ne"), F.sum(F.col("_act").cast("long")).alias("_na"), *aggs)
    terms = [_term(F.col(f"a{k}") / F.col("_na"), F.col(f"e{k}") / F.col("_ne")) for k in range(width)]
    return g.select("feature", sum(terms[1:], terms[0]).alias("psi"))


def psi(reference: DataFrame, actual: DataFrame, column: str, n_bins: int = 10) -> DataFrame:
    """One row: stability of one column between two frames."""
    cuts = reference_edges(reference, [column], n_bins)
    both = reference.select(column, F.lit(False).alias("_act")).unionByName(actual.select(column, F.lit(True).alias("_act")))
    return psi_per_feature(both, [column], F.col("_act"), cuts).select("psi")


def psi_by_period(
    df: DataFrame, column: str, reference: Column, by: Sequence[str | Column], n_bins: int = 10
) -> DataFrame:
    """Stability of each group of ``by`` against the fixed reference rows."""
    ref = df.where(reference)
    cuts = reference_edges(ref, [column], n_bins)[column]
    bin_no = left_closed_bin(F.col(column).cast("double"), cuts)
    known = ref.where(F.col(column).isNotNull())
    shares = {r["b"]: r["n"] for r in known.groupBy(bin_no.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    keys = [C.col(b) for b in by]
    rows = df.where(F.col(column).isNotNull()).select(*keys, bin_no.alias("_bin"))
    names = rows.columns[:-1]
    g = rows.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum((F.col("_bin") == k).cast("long")).alias(f"_a{k}") for k in range(len(cuts) + 1)]
    )
    terms = [_term(F.col(f"_a{k}") / F.col("n_rows"), F.lit(shares.get(k, 0) / total)) for k in range(len(cuts) + 1)]
    value = sum(terms[1:], terms[0])
    return g.select(*names, "n_rows", value.alias("psi"), C.banded(value, S.PSI_BANDS).alias("band"))


def reference_state(reference: DataFrame, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """(feature, cuts, n): cut points and rows per bin of the reference, one row a feature.

    Saved as a table, it is all that a later run needs of the reference rows.
    """
    cuts = reference_edges(reference, features, n_bins)
    spark = reference.sparkSession
    edges = spark.createDataFrame([(f, [float(c) for c in cuts[f]]) for f in features if f in cuts], "feature string, cuts array<double>")
    counts = period_counts(reference.withColumn("_all", F.lit(0)), edges, ["_all"])
    return edges.join(counts.select("feature", "n"), "feature", "left").select(
        "feature", "cuts", F.coalesce("n", F.array_repeat(F.lit(0).cast("long"), F.size("cuts") + 1)).alias("n")
    )


def period_counts(df: DataFrame, state: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """(keys, feature, n): rows per bin of ``state`` in each group; ``n`` is an array over the bins.

    Reads only the rows it is given; counts of further rows are added by ``add_counts``.
    """
    cuts = {r["feature"]: r["cuts"] for r in state.select("feature", "cuts").collect()}  # one row a feature
    keys = [C.col(b) for b in by]
    features = list(cuts)
    wide = df.select(*keys, *[left_closed_bin(F.col(f).cast("double"), cuts[f]).alias(f"_b{i}") for i, f in enumerate(features)])
    names = wide.columns[: len(keys)]
    parts = ", ".join(f"'{f}', _b{i}" for i, f in enumerate(features))
    rows = wide.selectExpr(*[f"`{c}`" for c in names], f"stack({len(features)}, {parts}) as (feature, bin)").where("bin is not null")
    width = max(len(c) for c in cuts.values()) + 1
    g = rows.groupBy(*names, "feature").agg(*[F.sum((F.col("bin") == k).cast("long")).alias(f"_n{k}") for k in range(width)])
    size = F.lit(width)
    for f, c in cuts.items():
        size = F.when(F.col("feature") == f, len(c) + 1).otherwise(size)
    return g.select(*names, "feature", F.slice(F.array(*[f"_n{k}" for k in range(width)]), F.lit(1), size).alias("n"))


def add_counts(*tables: DataFrame) -> DataFrame:
    """One table of counts from several, in any order and grouping: rows of the same group and feature add up."""
    both = tables[0]
    for more in tables[1:]:
        both = both.unionByName(more)
    keys = [c for c in both.columns if c != "n"]
    each = both.select(*keys, F.posexplode("n").alias("bin", "k"))
    summed = each.groupBy(*keys, "bin").agg(F.sum("k").alias("k"))
    return summed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "k"))), lambda x: x["k"]).alias("n"))


def psi_of_counts(counts: DataFrame, state: DataFrame) -> DataFrame:
    """(keys, feature, n_rows, psi, band) of counted groups against the saved reference."""
    rows = counts.join(state.select("feature", F.col("n").alias("ref")), "feature")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumns({"n_rows": total("n"), "_ref": total("ref")})
    term = F.zip_with("n", "ref", lambda a, e: _term(a / F.col("n_rows"), e / F.col("_ref")))
    value = F.aggregate(term, F.lit(0.0), lambda a, x: a + x)
    keys = [c for c in counts.columns if c != "n"]
    return rows.withColumn("psi", value).select(*keys, "n_rows", "psi", C.banded("psi", S.PSI_BANDS).alias("band"))
