"""Exact attribution of tree ensembles over all rows.

A leaf pays its value only if every feature on its path is satisfied. For the
path's distinct features this is a product game: a known feature contributes
1 or 0, an unknown one the share of training weight that follows the path. Its
Shapley values depend only on which features are satisfied, so each leaf has a
table of at most 2^depth patterns. A task finds the pattern of every row by
array comparison and looks the contributions up. The ensemble is sent to the tasks; its size is
bounded by trees x 2^depth nodes and checked. Tables are made for bounded groups of leaves: a task
holds the tables of one group, applies them to all rows it has gathered, and goes on to the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.operators.attribution import phi
from creditloom.sources.tables import shared_folder

MAX_NODES = 2_000_000
#: Bytes of leaf tables held at once, and rows gathered before the groups are gone through.
GROUP_BYTES = 64 << 20
GATHERED_ROWS = 50_000


@dataclass
class Leaf:
    value: float
    feature: np.ndarray  # distinct features of the path
    lo: np.ndarray  # satisfied iff lo < x <= hi
    hi: np.ndarray
    share: np.ndarray  # training weight share that follows the path

    def table(self) -> np.ndarray:
        """(2^u, u) contributions for every pattern of satisfied features."""
        return tables_of([self])[0]


def tables_of(leaves: Sequence[Leaf]) -> np.ndarray:
    """(leaf, 2^u, u) contribution tables of leaves with the same number u of features."""
    u = len(leaves[0].feature)
    share, value = np.stack([leaf.share for leaf in leaves]), np.array([leaf.value for leaf in leaves])
    ones = ((np.arange(1 << u)[:, None] >> np.arange(u)) & 1).astype(float)
    out = np.zeros((len(leaves), 1 << u, u))
    weights = np.array([factorial(k) * factorial(u - 1 - k) / factorial(u) for k in range(u)])
    for j in range(u):
        # Coefficient k: sum over coalitions of k others.
        poly = np.zeros((len(leaves), 1 << u, u))
        poly[..., 0] = 1.0
        for i in range(u):
            if i != j:
                shifted = poly[..., :-1] * ones[None, :, i : i + 1]
                poly *= share[:, None, i, None]
                poly[..., 1:] += shifted
        out[..., j] = (ones[None, :, j] - share[:, None, j]) * (poly @ weights)
    return out * value[:, None, None]


def table_groups(leaves: Sequence[Leaf], limit: int) -> list[list[int]]:
    """Leaf numbers in groups of one feature count whose tables take at most ``limit`` bytes (or one leaf)."""
    groups: list[list[int]] = []
    order = sorted((k for k in range(len(leaves)) if len(leaves[k].feature)), key=lambda k: (len(leaves[k].feature), k))
    size, kind = 0, 0
    for k in order:
        u = len(leaves[k].feature)
        own = (8 * u) << u
        if not groups or u != kind or size + own > limit:
            groups.append([])
            size, kind = 0, u
        groups[-1].append(k)
        size += own
    return groups


def _leaves(nodes: dict[int, tuple], factor: float) -> list[Leaf]:
    """Walk one tree; conditions on the same feature merge into one interval."""
    found: list[Leaf] = []
    pending = [(0, {})]
    while pending:
        node, path = pending.pop()
        value, cover, left, right, feature, cut = nodes[node]
        if left < 0:
            keys = sorted(path)
            lo, hi, share = (np.array([path[k][i] for k in keys], float) for i in range(3))
            found.append(Leaf(value * factor, np.array(keys, int), lo, hi, share))
            continue
        for child, is_left in ((left, True), (right, False)):
            lo, hi, share = path.get(feature, (-np.inf, np.inf, 1.0))
            part = nodes[child][1] / cover if cover else 0.0
            step = (lo, min(hi, cut), share * part) if is_left else (max(lo, cut), hi, share * part)
            pending.append((child, {**path, feature: step}))
    return found


def ensemble_leaves(model, spark) -> list[Leaf]:
    """Leaves of a fitted ensemble, read from its saved node table.

    Boosted models are explained in log-odds (twice the margin), forests in
    probability. Covers are weighted.
    """
    import uuid

    path = f"{shared_folder(spark)}/ensemble-{uuid.uuid4().hex}"
    model.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    boosted = isinstance(model, GBTClassificationModel)
    n = F.col("nodeData")
    rows = table.select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("prediction"), n["impurityStats"].alias("stats"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"),
    ).limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError("the ensemble is too large to send to the tasks")
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows:
        cover = r["stats"][0] if boosted else sum(r["stats"])
        value = r["prediction"] if boosted else (r["stats"][1] / cover if cover else 0.0)
        trees.setdefault(r["treeID"], {})[r["id"]] = (value, cover, r["left"], r["right"], r["feature"], r["cut"])
    weights = model.treeWeights if boosted else [1.0 / len(trees)] * len(trees)
    return [leaf for t in sorted(trees) for leaf in _leaves(trees[t], weights[t] * (2.0 if boosted else 1.0))]


def base_value(leaves: Sequence[Leaf]) -> float:
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))


def attribution_tree(
    df: DataFrame, model, features: Sequence[str], key: str = S.ID, sample: float | None = None, seed: int = S.SEED, values: bool = True
) -> DataFrame:
    """Contribution frame of a fitted Spark tree ensemble; all rows by default.

    Features that no tree asks for contribute 0 and are not computed. Without ``values`` the feature columns are left
    out, and only those that the trees ask for move to the tasks' Python.
    """
    spark = df.sparkSession
    leaves = ensemble_leaves(model, spark)
    base = base_value(leaves)
    asked = sorted({int(f) for leaf in leaves for f in leaf.feature})
    moved = list(range(len(features))) if values else asked
    place = {f: i for i, f in enumerate(moved)}
    shared = spark.sparkContext.broadcast(leaves)
    rows = df.sample(fraction=sample, seed=seed) if sample else df
    narrow = rows.select(key, *[F.col(features[f]).cast("double").alias(features[f]) for f in moved])
    kept_columns = [key, *(features if values else ())]
    limit, gathered = GROUP_BYTES, GATHERED_ROWS

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        groups = table_groups(held, limit)
        fits = sum((8 * len(held[k].feature)) << len(held[k].feature) for g in groups for k in g) <= limit
        kept = [tables_of([held[k] for k in g]) for g in groups] if fits else None

        def contributions(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = {f: batch.columns[1 + place[f]].to_numpy(zero_copy_only=False) for f in asked}
            out = {f: np.zeros(batch.num_rows) for f in asked}
            for g, numbers in enumerate(groups):
                tables = kept[g] if kept else tables_of([held[k] for k in numbers])
                for table, k in zip(tables, numbers, strict=True):
                    leaf = held[k]
                    pattern = np.zeros(batch.num_rows, int)
                    for u, f in enumerate(leaf.feature):
                        pattern |= ((x[f] > leaf.lo[u]) & (x[f] <= leaf.hi[u])).astype(int) << u
                    part = table[pattern]
                    for u, f in enumerate(leaf.feature):
                        out[f] += part[:, u]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept_columns), *[pa.array(out[f]) for f in asked]],
                names=[*kept_columns, *[phi(features[f]) for f in asked]],
            )

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if kept or sum(b.num_rows for b in waiting) >= gathered:
                yield from map(contributions, pa.Table.from_batches(waiting).combine_chunks().to_batches())
                waiting = []
        if waiting:
            yield from map(contributions, pa.Table.from_batches(waiting).combine_chunks().to_batches())

    fields = [f"`{key}` {dict(narrow.dtypes)[key]}"] + [f"`{c}` double" for c in kept_columns[1:]]
    fields += [f"`{phi(features[f])}` double" for f in asked]
    found = narrow.mapInArrow(explain, ", ".join(fields))
    every = [F.col(f"`{phi(f)}`") if i in set(asked) else F.lit(0.0).alias(phi(f)) for i, f in enumerate(features)]
    return found.select(*[F.col(f"`{c}`") for c in kept_columns], *every, F.lit(base).alias("base"))
