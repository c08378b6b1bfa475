"""Synthetic minority rows between a row and one of its nearest neighbours.

Neighbours come from a join of random projections. Equal vectors collapse to one point with a count, so copies
never pile up. In each of several tables the points are cut by quantiles of one random
projection after the other, every bucket on its own, until a bucket holds about ``LEAF`` points; ties
are cut by count. Points that share a bucket in any table are compared exactly, and the best
``k`` of all tables are kept; a point that asks for fewer, or for none, only sends these. Neighbours are approximate: a near pair may be parted in every
table (the recall is measured in the tests). The first cuts are counted by Spark, until a part fits a task; each point
then moves once a table, and the task cuts its part further. Only the first cuts reach the driver, no points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.sources.tables import stage

#: Points of a bucket, independent tables, and parts a bucket is cut into at once, at most.
LEAF = 256
TABLES = 8
FAN_OUT = 8
#: Numbers of the points that one task cuts into buckets.
PART_VALUES = 1 << 22


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def _projected(x: np.ndarray, t: int, levels: int, seed: int) -> np.ndarray:
    """The projections of each point on the random directions of table ``t``, summed in one order whatever the batch."""
    directions = np.random.default_rng([seed, t]).normal(size=(x.shape[1], levels))
    p = np.zeros((len(x), levels))
    for j, along in enumerate(directions):
        p += x[:, j : j + 1] * along
    return p


def _side(p: np.ndarray, t: int, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bucket that the cuts found so far put each point into."""
    bucket = np.zeros(len(p), np.int64)
    for level, cuts in enumerate(edges):
        bucket = bucket * (cuts.shape[2] + 1) + (cuts[t, bucket] < p[:, level, None]).sum(1)
    return bucket


def _leaves(p: np.ndarray, fan: int) -> np.ndarray:
    """Bucket numbers of the points of one part: each bucket is cut evenly by one projection after the other, ties by order."""
    bucket = np.zeros(len(p), np.int64)
    for v in p.T:
        order = np.lexsort((v, bucket))
        ends = np.bincount(bucket)
        size, start = ends[bucket[order]], (np.cumsum(ends) - ends)[bucket[order]]
        bucket[order] = bucket[order] * fan + (np.arange(len(p)) - start) * fan // size
    return bucket


class _Plan:
    """How the points of all tables are dealt to parts of a bounded size, and cut into buckets inside them.

    A part holds ``PART_VALUES`` numbers or fewer (twice that where cuts are uneven). Only the cuts between parts
    are fitted ahead, in one counting pass a level.
    """

    def __init__(self, points: DataFrame, leaf: int, tables: int, seed: int):
        n, dim = points.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        pieces, self.part = max(1, -(-n // leaf)), max(2 * leaf, PART_VALUES // max(dim or 1, 1))
        self.tables, self.seed = tables, seed
        self.levels = max(1, math.ceil(math.log(pieces, FAN_OUT) - 1e-9))
        self.fan = math.ceil(pieces ** (1.0 / self.levels) - 1e-9)
        self.edges: list[np.ndarray] = []
        self.split: dict[tuple[int, int], int] = {}
        while n > self.part * self.fan ** len(self.edges) and len(self.edges) < self.levels and self.fan > 1:
            self.edges.append(self._cuts(points))
        if n > self.part:
            # Equal projections cannot be parted by a cut: such a part is dealt by digest.
            sizes = self._sides(points, len(self.edges)).groupBy("t", "bucket").count().where(F.col("count") > 2 * self.part)
            self.split = {(r["t"], r["bucket"]): -(-r["count"] // self.part) for r in sizes.collect()}

    def _sides(self, points: DataFrame, level: int) -> DataFrame:
        """t, bucket, v: the bucket of each point after ``level`` cuts and its next projection, if there is one."""
        tables, seed, levels, edges = self.tables, self.seed, self.levels, list(self.edges)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("x"), batch.num_rows)
                for t in range(tables if batch.num_rows else 0):
                    p = _projected(x, t, levels, seed)
                    columns = [np.full(len(x), t, np.int32), _side(p, t, edges), np.ascontiguousarray(p[:, min(level, levels - 1)])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t", "bucket", "v"])

        return points.select("x").mapInArrow(work, "t int, bucket long, v double")

    def _cuts(self, points: DataFrame) -> np.ndarray:
        level, fan = len(self.edges), self.fan
        shares = F.array(*[F.lit(i / fan) for i in range(1, fan)])
        found = self._sides(points, level).groupBy("t", "bucket").agg(F.percentile_approx("v", shares, 1000).alias("cuts"))
        cuts = np.full((self.tables, fan**level, fan - 1), np.inf)
        for r in found.collect():
            cuts[r["t"], r["bucket"]] = r["cuts"]
        return cuts

    def dealt(self, points: DataFrame) -> DataFrame:
        """t, part, id, x, m (and need): every point once a table, the points of a part in one partition."""
        tables, seed, levels, edges, split = self.tables, self.seed, self.levels, self.edges, self.split
        parts = self.fan ** len(edges)
        kept = {"id": "long", "x": "array<double>", "m": "long"} | ({"need": "int"} if "need" in points.columns else {})

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, ids = _matrix(batch.column("x"), batch.num_rows), batch.column("id").to_numpy()
                for t in range(tables if batch.num_rows else 0):
                    part = _side(_projected(x, t, levels, seed), t, edges) if edges else np.zeros(len(x), np.int64)
                    for (table, bucket), ways in split.items():
                        if table == t:
                            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % ways
                            part = np.where(part == bucket, bucket + spread * parts, part)
                    columns = [pa.array(np.full(len(x), t, np.int32)), pa.array(part), *[batch.column(c) for c in kept]]
                    yield pa.RecordBatch.from_arrays(columns, ["t", "part", *kept])

        rows = points.select(*kept).mapInArrow(work, "t int, part long, " + ", ".join(f"{c} {kind}" for c, kind in kept.items()))
        groups = tables * parts + sum(self.split.values())
        return rows.repartition(groups, "t", "part") if groups > 1 else rows

    def cut(self, table: pa.Table) -> tuple[np.ndarray, ...]:
        """x, bucket, and id, m (and need) of the points of one part, ordered by id, so that ties are settled alike everywhere."""
        kept = [table.column(c).to_numpy() for c in table.column_names if c not in ("t", "part", "x")]
        order = np.argsort(kept[0])
        x, kept = _matrix(table.column("x"), table.num_rows)[order], [c[order] for c in kept]
        t, part = table.column("t")[0].as_py(), table.column("part")[0].as_py()
        inner = self.levels - len(self.edges)
        p = _projected(x, t, self.levels, self.seed)[:, len(self.edges) :]
        bucket = part * self.fan**inner + (_leaves(p, self.fan) if self.fan > 1 else 0)
        return x, np.broadcast_to(bucket, len(x)), *kept


def buckets(points: DataFrame, leaf: int = LEAF, tables: int = TABLES, seed: int = S.SEED) -> DataFrame:
    """t, id, bucket: buckets of about ``leaf`` points in each table."""
    plan = _Plan(points, leaf, tables, seed)

    def work(table: pa.Table) -> pa.Table:
        _, bucket, ids, *_ = plan.cut(table)
        return pa.table({"t": table.column("t"), "id": ids, "bucket": bucket.copy()})

    return plan.dealt(points).groupBy("t", "part").applyInArrow(work, "t int, id long, bucket long")


def _nearest(x: np.ndarray, ids: np.ndarray, m: np.ndarray, need: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The nearest points of each point of one bucket, as many as it needs and k at most: id, distance, id of the other and its copies."""
    n, asking = len(x), np.flatnonzero(need > 0)
    for lo in range(0, len(asking), 256):
        ask = asking[lo : lo + 256]
        d = np.zeros((len(ask), n))
        for j in range(x.shape[1]):
            d += (x[ask, j, None] - x[None, :, j]) ** 2
        np.sqrt(d, out=d)
        d[np.arange(len(ask)), ask] = np.inf
        take = min(k, n - 1)
        near = np.argsort(d, axis=1, kind="stable")[:, :take]
        sent = np.arange(take) < need[ask, None]
        yield np.repeat(ids[ask], sent.sum(1)), np.take_along_axis(d, near, 1)[sent], ids[near][sent], m[near][sent]


def nearest_neighbours(points: DataFrame, k: int, leaf: int = LEAF, tables: int = TABLES, seed: int = S.SEED) -> DataFrame:
    """(id, near): the k nearest points found for each distinct point, nearest first, as (d, id, m).

    ``points`` has (id long, x array<double>, m long) with distinct ``x``, and may have ``need int``: how many neighbours
    a point asks for where it is not k; what follows these is not complete. A point that asks for none, or is alone in all
    its buckets, has no row.
    """
    if "need" not in points.columns:
        points = points.withColumn("need", F.lit(k))
    plan = _Plan(points, leaf, tables, seed)

    def work(table: pa.Table) -> pa.Table:
        x, bucket, ids, m, need = plan.cut(table)
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order])) + 1
        found = [f for rows in np.split(order, ends) for f in _nearest(x[rows], ids[rows], m[rows], need[rows], k)]
        who, d, to, copies = (np.concatenate(c) for c in zip((ids[:0], x[:0, 0], ids[:0], m[:0]), *found, strict=True))
        return pa.table({"id": who, "d": d, "to": to, "copies": copies})

    pairs = plan.dealt(points).groupBy("t", "part").applyInArrow(work, "id long, d double, to long, copies long")
    # The distance of a pair is summed in one order everywhere, so the finds of several tables are equal. Every table is
    # a group of its own, so nothing would be gained by putting the finds of a task together before they move.
    best = pairs.repartition("id").groupBy("id").agg(F.collect_set(F.struct("d", F.col("to").alias("id"), F.col("copies").alias("m"))).alias("near"))
    return best.select("id", F.slice(F.array_sort("near"), 1, k).alias("near"))


def _first_rows(rows: DataFrame, n: int, seed: int) -> Column:
    """Holds for the ``n`` of the rows (id, r) whose digest comes first.

    The leading digits give even slices: counting these finds the one that holds the last of the rows, and only that
    slice is ordered. No row moves for it.
    """
    digest = C.hash_hex(seed, F.lit("extra"), "id", "r", width=32)
    lead = F.substring(digest, 1, 3)
    for s in rows.groupBy(lead.alias("lead")).agg(F.count(F.lit(1)).alias("n")).orderBy("lead").collect():
        if n <= s["n"]:
            break
        n -= s["n"]
    head = rows.where(lead == s["lead"]).select(digest.alias("h"), "id").orderBy("h", "id").limit(n)
    last = head.agg(F.max(F.struct("h", "id")).alias("last")).first()["last"]
    return F.struct(digest.alias("h"), F.col("id")) <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["id"]).alias("id"))


def smote(
    train: DataFrame, features: Sequence[str], label: str = S.TARGET, key: str = S.ID, k: int = 5,
    ratio: float = 1.0, seed: int = S.SEED, leaf: int = LEAF, tables: int = TABLES, trace: bool = False,
) -> DataFrame:
    """Synthetic minority rows (features, label): exactly as many as are missing to ``ratio`` x majority.

    Every minority row makes the same number, and the rows whose digest comes first make one more.
    Neighbour and position on the segment are chosen by digest, so a rerun gives the same rows.
    ``trace`` adds ``from_id``, ``to_id`` and ``step``. Features must not be null.
    """
    counts = {r["y"]: r["n"] for r in train.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect() if r["y"] is not None}
    small = min(counts, key=lambda y: (counts[y], -y))
    missing = max(0, round(ratio * max(counts.values())) - counts[small])
    whole, rest = divmod(missing, counts[small])
    points = train.where(F.col(label) == small).groupBy(F.array(*[F.col(f).cast("double") for f in features]).alias("x")).agg(
        F.min(F.col(key).cast("long")).alias("id"), F.count(F.lit(1)).alias("m")
    ).select("id", "x", "m")
    points = stage(points, "minority-points")  # counted, projected and joined
    # Copies of a point are spread in blocks before they become rows.
    block = 10_000
    row = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("r")
    few, many = points.where(F.col("m") <= block), points.where(F.col("m") > block)
    blocks = many.select("*", F.explode(F.sequence(F.lit(0), ((F.col("m") - 1) / block).cast("long"))).alias("b")).repartition("id", "b")
    rows = few.select("*", row).unionByName(blocks.select(
        *points.columns, F.explode(F.sequence(F.col("b") * block, F.least((F.col("b") + 1) * block, F.col("m")) - 1)).alias("r")
    ))
    n = F.lit(whole)
    if rest:
        n = n + _first_rows(rows, rest, seed).cast("int")
    pick = F.floor(C.hash_unit(seed, F.lit("near"), "id", "r", "c") * k)
    step = C.hash_unit(seed, F.lit("step"), "id", "r", "c")
    made = rows.withColumn("n", n).where("n > 0").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("n"))))
    made = made.select("id", "x", "m", pick.alias("pick"), step.alias("step"))
    # A point asks for no more neighbours than its new rows pick from; one with copies as if they picked the last.
    once = points.where("m = 1").withColumn("r", F.lit(0).cast("long")).withColumn("n", n)
    most = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n")), lambda c: F.floor(C.hash_unit(seed, F.lit("near"), "id", "r", c) * k)))
    asked = once.select("id", "x", "m", F.when(F.col("n") > 0, most + 1).otherwise(0).cast("int").alias("need")).unionByName(
        points.where("m > 1").select("id", "x", "m", F.greatest(F.lit(k + 1) - F.col("m"), F.lit(0)).cast("int").alias("need"))
    )
    near = nearest_neighbours(asked, k, leaf, tables, seed)
    # The first m - 1 neighbours of a point with copies are the copies themselves.
    to = F.aggregate(
        F.coalesce("near", F.array().cast("array<struct<d: double, id: bigint, m: bigint>>")),
        F.struct((F.col("m") - 1).alias("s"), F.col("id").alias("id")).cast("struct<s: bigint, id: bigint>"),
        lambda acc, e: F.struct((acc["s"] + e["m"]).alias("s"), F.when(acc["s"] <= F.col("pick"), e["id"]).otherwise(acc["id"]).alias("id")),
    )["id"]
    pairs = made.join(near, "id", "left").select(F.col("id").alias("from_id"), "x", to.alias("to_id"), "step")
    ends = points.select(F.col("id").alias("to_id"), F.col("x").alias("y"))
    new = F.zip_with("x", "y", lambda a, b: a + F.col("step") * (b - a))
    return pairs.join(ends, "to_id").select(
        *[F.get(new, F.lit(i)).alias(f) for i, f in enumerate(features)], F.lit(int(small)).alias(label),
        *(["from_id", "to_id", "step"] if trace else []),
    )
