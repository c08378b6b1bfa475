"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import stage


def smallest_reachable(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node reachable over links between ``a`` and ``b``.

    Alternates large-star and small-star steps: in each, every node hangs its
    neighbours on the smallest of them. Neighbourhoods are reduced to their minimum by
    partial aggregation and met by joins, so no node's links are ever gathered in
    one place. Each step is staged. Nodes without links do not appear; loops
    and repeated links change nothing.
    """
    edges = stage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Staged, so that the join below starts from shuffles whose large parts can be split.
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # Large star: larger neighbours hang on the smallest node of the neighbourhood.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        # Small star: each node and its smaller neighbours hang on the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        small = stage(small, "small-star")
        # Done when every node hangs on one root and no root hangs on another.
        odd = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        chained = small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() if not odd else 1
        edges = small
        if not odd and not chained:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
