"""Probabilities of random forests, many rows a node.

Spark's model walks all trees for one row, then for the next: with hundreds of trees every step waits for memory, and a
task unpacks the node objects of its own. Here a task holds the trees as arrays and puts the leaves of a
block of rows together from the lowest nodes up, a few operations over bytes a node. The votes are summed in the order of
the trees, as Spark does, so that the probabilities are the same to the last bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.sources.tables import shared_folder

@dataclass
class Tree:
    """Nodes from the root on, children after their parents; leaves have no children (-1)."""

    feature: np.ndarray
    cut: np.ndarray  # left iff x <= cut
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # (node, class) shares of the training weight


_read: WeakKeyDictionary = WeakKeyDictionary()


def forest_of(model: RandomForestClassificationModel, spark: SparkSession) -> list[Tree]:
    """The trees of a fitted model, read once from its saved node table."""
    if model not in _read:
        path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
        model.write().save(path)
        n = F.col("nodeData")
        nodes = spark.read.parquet(f"{path}/data").select(
            "treeID", n["id"].alias("id"), n["impurityStats"].alias("stats"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
            n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"),
        )
        _read[model] = _trees(nodes.toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")]), model.numClasses)
    return _read[model]


def _trees(nodes: pa.Table, classes: int) -> list[Tree]:
    tree, feature, left, right = (nodes[c].to_numpy() for c in ("treeID", "feature", "left", "right"))
    cut = nodes["cut"].to_numpy()
    stats = nodes["stats"].combine_chunks().flatten().to_numpy().reshape(-1, classes)
    total = _total(stats)
    share = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
    parts = np.split(np.arange(len(tree)), np.flatnonzero(np.diff(tree)) + 1)
    return [Tree(feature[p], cut[p], left[p], right[p], share[p]) for p in parts]


def _total(x: np.ndarray) -> np.ndarray:
    """(row, 1) sums, column after column."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out = out + x[:, k]
    return out[:, None]


class Scorer:
    """Probabilities of the class 1 by several forests over the same features.

    A value stands for its place among all cuts of its feature, in a byte if there are few enough.
    """

    def __init__(self, forests: Sequence[Sequence[Tree]], features: int):
        feature, cut, left = (np.concatenate([getattr(t, c) for f in forests for t in f]) for c in ("feature", "cut", "left"))
        self.cuts = [np.unique(cut[(feature == j) & (left >= 0)]) for j in range(features)]
        self.kind = np.min_scalar_type(max(len(c) for c in self.cuts))
        self.forests = [[self._steps(tree) for tree in f] for f in forests]

    def _steps(self, tree: Tree) -> tuple:
        """Inner nodes (node, feature, place of the cut, left, right) from the last to the root, the numbers of the leaves, and the leaves' shares."""
        leaves = np.flatnonzero(tree.left < 0)
        number = np.zeros(len(tree.left), np.min_scalar_type(len(leaves) - 1))
        number[leaves] = np.arange(len(leaves))
        inner = [
            (int(n), int(j := tree.feature[n]), self.kind.type(np.searchsorted(self.cuts[j], tree.cut[n])), int(tree.left[n]), int(tree.right[n]))
            for n in np.flatnonzero(tree.left >= 0)[::-1]
        ]
        return inner, {int(n): number[n] for n in leaves}, number.dtype, np.ascontiguousarray(tree.share[leaves].T)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(row, forest) probabilities."""
        places = [np.searchsorted(c, x[:, j]).astype(self.kind) for j, c in enumerate(self.cuts)]
        out = np.empty((len(x), len(self.forests)))
        for i, forest in enumerate(self.forests):
            votes = np.zeros((len(forest[0][3]), len(x)))
            for inner, leaves, kind, share in forest:
                leaf = dict(leaves)
                for n, feature, place, left, right in inner:
                    # All bits set where the row goes to the right.
                    goes = np.negative((places[feature] > place).view(np.uint8).astype(kind, copy=False))
                    a, b = leaf.pop(left), leaf.pop(right)
                    goes &= a ^ b
                    goes ^= a
                    leaf[n] = goes
                at = leaf[0]
                for k, s in enumerate(share):
                    votes[k] += s.take(at) if inner else s[0]
            total = _total(votes.T)[:, 0]
            out[:, i] = np.divide(votes[1], total, out=votes[1].copy(), where=total != 0)
        return out


def forest_probabilities(df: DataFrame, models: Sequence[RandomForestClassificationModel], vector: str, out: str) -> DataFrame:
    """Add ``out``: the probability of class 1 by each model, an array."""
    spark, features = df.sparkSession, models[0].numFeatures
    shared = spark.sparkContext.broadcast(Scorer([forest_of(m, spark) for m in models], features))

    @F.arrow_udf("array<double>")
    def probability(vectors: pa.Array) -> pa.Array:
        found = shared.value(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, features))
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())

    return df.withColumn(out, probability(vector_to_array(F.col(vector))))
