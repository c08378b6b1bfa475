"""Train/validation/test splits, folds and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators.ranking import row_ranks


def split_of(test: float = 0.2, val: float = 0.2, seed: int = S.SEED, key: str = S.ID) -> Column:
    """Split name by digest of the id: no shuffle, stable when rows arrive."""
    h = C.hash_hex(seed, key)
    return (
        F.when(h < F.lit(C.hex_threshold(1.0 - test - val)), "train")
        .when(h < F.lit(C.hex_threshold(1.0 - test)), "val")
        .otherwise("test")
    )


def stratified_split(
    df: DataFrame, label: str = S.TARGET, test: float = 0.2, val: float = 0.2,
    seed: int = S.SEED, key: str = S.ID, exact: bool = False,
) -> DataFrame:
    """Add ``split``. ``exact`` cuts each class at exact counts by digest rank."""
    if not exact:
        return df.withColumn("split", split_of(test, val, seed, key))
    ranked = row_ranks(df.withColumn("_h", C.hash_hex(seed, key, width=32)), [label], "_h", key, out="_r")
    n = F.col("_r_total")
    split = (
        F.when(F.col("_r") < F.floor(n * (1.0 - test - val) + 0.5), "train")
        .when(F.col("_r") < F.floor(n * (1.0 - test) + 0.5), "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("_h", "_r", "_r_total")


def stratified_folds(df: DataFrame, k: int = 5, label: str = S.TARGET, seed: int = S.SEED, key: str = S.ID) -> DataFrame:
    """Add ``fold``: class members are dealt out in digest order, so sizes differ by one at most."""
    keyed = df.withColumn("_h", C.hash_hex(seed, F.lit("fold"), key, width=32))
    return row_ranks(keyed, [label], "_h", key, out="_r").withColumn("fold", (F.col("_r") % k).cast("int")).drop("_h", "_r", "_r_total")


def class_counts(df: DataFrame, label: str = S.TARGET) -> dict[int, int]:
    return {int(r["y"]): r["n"] for r in df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect() if r["y"] is not None}


def positive_weight(counts: dict[int, int]) -> float:
    return counts.get(0, 0) / max(counts.get(1, 0), 1)


def class_weight(counts: dict[int, int], label: str = S.TARGET, scheme: str = "balanced", fixed: float = 5.0) -> Column:
    """Row weight: 'balanced' n/(2 n_k), 'ratio' n0/n1 on positives, 'fixed' on positives."""
    y = F.col(label)
    if scheme == "balanced":
        n = sum(counts.values())
        w = {k: n / (2.0 * max(c, 1)) for k, c in counts.items()}
        return F.when(y == 1, F.lit(w.get(1, 1.0))).otherwise(F.lit(w.get(0, 1.0)))
    up = positive_weight(counts) if scheme == "ratio" else fixed
    return F.when(y == 1, F.lit(float(up))).otherwise(F.lit(1.0))


def class_weight_table(df: DataFrame, label: str = S.TARGET) -> DataFrame:
    """One row of counts and weights, lazily."""
    y = F.col(label)
    n1, n0 = F.sum((y == 1).cast("long")), F.sum((y == 0).cast("long"))
    return df.agg(n0.alias("n0"), n1.alias("n1")).select(
        "n0", "n1",
        (F.col("n0") / F.greatest("n1", F.lit(1))).alias("scale_pos_weight"),
        ((F.col("n0") + F.col("n1")) / (2.0 * F.col("n0"))).alias("balanced_0"),
        ((F.col("n0") + F.col("n1")) / (2.0 * F.col("n1"))).alias("balanced_1"),
    )
