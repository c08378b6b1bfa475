"""Exact top-k search by a pivot-distance index.

Largest inner products become nearest neighbours by one more coordinate: with
M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by its nearest pivot and
its distance from it; a pivot's vectors, sorted by distance, form annuli.
A query asks first in the slab around its own distance at its nearest pivot,
which gives a bound; then it visits every slab that the triangle inequality
``|q' - x'| >= |d(q', p) - d(x', p)|`` does not rule out, and inside a slab
expands the annuli from the nearest on until the bound stops it. Scores are
integers and compared exactly; the bound carries slack for rounding.

Pivots are fitted on a bounded sample (``SAMPLE`` rows); every row is indexed.
A slab holds at most about ``SLAB`` rows: annuli are joined or dealt into parts by
their counts, of which there are at most pivots x bins. Of equal vectors only the
k + 1 smallest ids can appear in any answer, so the others are dropped from the index
(not from the queries), which also takes the weight off very common vectors.

Rows: a vector that is null or has null or non-finite components, and a row
with null id, takes no part; shorter vectors count as filled with zeros; equal rows are
rows of their own, as candidates and as queries: a query leaves out only itself. They are indexed once with their number; empty tables give empty results; a query with fewer than k candidates gets all. Components and
inner products have to fit 64 bits. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.common import partitions_for, query, read, stage

TOP = 5
PIVOTS = 32
SAMPLE = 4096
BINS = 256
SLAB = 4096
ANNULUS = 512
_BLOCK = 1024
_KINDS = {1: "<i1", 2: "<i2", 4: "<i4", 8: "<i8"}


def _pack(v: np.ndarray) -> bytes:
    """Shortest form of an integer vector: one byte for the width, then the components."""
    top = int(np.abs(v).max()) if len(v) else 0
    width = next(w for w in _KINDS if top < 1 << (8 * w - 1) or w == 8)
    return bytes([width]) + v.astype(_KINDS[width]).tobytes()


def _unpack(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for i, r in enumerate(rows):
        v = np.frombuffer(r, dtype=_KINDS[r[0]], offset=1)
        out[i, : len(v)] = v
    return out


def quantise(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, vec, norm2, dim: integer vectors floor(scale * x) of the rows that take part."""
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    whole = given.where("vec_id IS NOT NULL AND e IS NOT NULL").where(
        ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.floor(np.asarray(v, dtype=np.float64) * scale).astype(np.int64) for v in batch.column("e").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "vec": pa.array([_pack(v) for v in each], pa.binary()),
                "norm2": pa.array([int(v @ v) for v in each], pa.int64()), "dim": pa.array([len(v) for v in each], pa.int32()),
            })

    return whole.mapInArrow(work, "vec_id long, vec binary, norm2 long, dim int")


def _lift(v: np.ndarray, norm2: np.ndarray, top2: int) -> np.ndarray:
    return np.column_stack([v.astype(np.float64), np.sqrt(np.maximum(top2 - norm2.astype(np.float64), 0))])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _fit_pivots(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Cluster centres of the bounded sample, started from spread-out rows."""
    centres = sample[:1]
    while len(centres) < min(n, len(sample)):
        far = _distances(sample, centres).min(axis=1)
        if far.max() == 0:
            break
        centres = np.vstack([centres, sample[int(far.argmax())]])
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(axis=1)
        centres = np.array([sample[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return centres


class _Layout:
    """Slabs of the index: rows of ``edges`` are pivot, lowest and highest distance, parts."""

    def __init__(self, counts: list[tuple[int, int, int]], width: float):
        self.slab_of: dict[tuple[int, int], int] = {}
        self.edges: list[list[float]] = []
        self.parts: list[int] = []
        held, last = 0, None
        for pivot, b, n in sorted(counts):
            if last != pivot or held + n > SLAB:
                self.edges.append([pivot, b * width, 0.0])
                self.parts.append(0)
                held, last = 0, pivot
            held += n
            self.slab_of[pivot, b] = len(self.edges) - 1
            self.edges[-1][2] = (b + 1) * width
            self.parts[-1] = -(-held // SLAB)
        self.table = np.array(self.edges, dtype=np.float64).reshape(-1, 3)

    def gaps(self, apart: np.ndarray) -> np.ndarray:
        """Least distance of each query to what each slab can hold, from its distances to the pivots."""
        d = apart[:, self.table[:, 0].astype(int)]
        return np.maximum(np.maximum(self.table[:, 1] - d, d - self.table[:, 2]), 0)


def _key_rows(vectors: DataFrame, pivots: np.ndarray, top2: int, dim: int) -> DataFrame:
    """Nearest pivot and distance of each indexed vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _unpack(batch.column("vec").to_pylist(), dim)
                apart = _distances(_lift(v, batch.column("norm2").to_numpy(), top2), pivots)
                near = apart.argmin(axis=1)
                at = apart[np.arange(len(near)), near]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vec"), pa.array(near, pa.int32()), pa.array(at)], ["vec_id", "vec", "pivot", "dist"]
                )

    return vectors.select("vec_id", "vec", "norm2").mapInArrow(work, "vec_id long, vec binary, pivot int, dist double")


def _ask(asks: DataFrame, pivots: np.ndarray, layout: _Layout, top2: int, dim: int, first: bool) -> DataFrame:
    """Rows (unit, ask, vec, bound) for the slabs each query has to visit.

    ``first``: only the slab nearest to the query's place. Else all others that
    may hold a score of at least ``bound``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                v = _unpack(part.column("vec").to_pylist(), dim)
                square = (v.astype(np.float64) ** 2).sum(axis=1)
                apart = _distances(np.column_stack([v.astype(np.float64), np.zeros(len(v))]), pivots)
                gaps = layout.gaps(apart)
                # Among slabs at equal gap the one of the nearest pivot is home.
                home = np.lexsort((np.broadcast_to(apart[:, layout.table[:, 0].astype(int)], gaps.shape), gaps), axis=1)[:, 0]
                if first:
                    who, slab = np.arange(len(v)), home
                else:
                    bound = part.column("bound").to_numpy(zero_copy_only=False)
                    best = (square[:, None] + top2 - gaps**2) / 2
                    open_ = best + 1 + 1e-9 * (square[:, None] + top2) >= bound[:, None]
                    open_[np.arange(len(v)), home] = False
                    who, slab = np.nonzero(open_)
                times = np.array(layout.parts, dtype=np.int64)[slab]
                who, slab = np.repeat(who, times), np.repeat(slab, times)
                piece = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                took = part.select(["ask", "vec", "bound"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array((slab.astype(np.int64) << 32) + piece), *took.columns], ["unit", "ask", "vec", "bound"])

    return asks.mapInArrow(work, "unit long, ask long, vec binary, bound double")


def _top(asks: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k rows of each ask: largest score, then smallest id."""
    order = np.lexsort((ids, -scores, asks))
    a = asks[order]
    head = np.flatnonzero(np.diff(a, prepend=-1))
    rank = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
    order = order[rank < k]
    return asks[order], scores[order], ids[order]


def _scan(q: np.ndarray, bound: np.ndarray, apart: np.ndarray, v: np.ndarray, ids: np.ndarray, dist: np.ndarray, top2: int, k: int):
    """Best k of one slab part for a block of queries; v sorted by distance from the pivot."""
    square = (q.astype(np.float64) ** 2).sum(axis=1)
    exact = len(v) and float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < 2**52
    left, right = (q.astype(np.float64), v.astype(np.float64)) if exact else (q, v)
    cuts = list(range(0, len(v), ANNULUS))
    low, high = dist[cuts], dist[[min(c + ANNULUS, len(v)) - 1 for c in cuts]]
    gaps = np.maximum(np.maximum(low[None, :] - apart[:, None], apart[:, None] - high[None, :]), 0)
    reach = (square[:, None] + top2 - gaps**2) / 2 + 1 + 1e-9 * (square[:, None] + top2)
    bound = bound.copy()
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for n in np.argsort(gaps.min(axis=0), kind="stable"):
        live = np.flatnonzero(reach[:, n] >= bound)
        if not len(live):
            continue
        rows = slice(cuts[n], cuts[n] + ANNULUS)
        scores = left[live] @ right[rows].T
        i, j = np.nonzero(scores >= bound[live][:, None])
        best = _top(
            np.concatenate([best[0], live[i]]), np.concatenate([best[1], scores[i, j].astype(np.int64)]), np.concatenate([best[2], ids[rows][j]]), k
        )
        # The k-th best so far is the new bound of a query that has k.
        counts = np.bincount(best[0], minlength=len(q))
        last = np.cumsum(counts) - 1
        full = np.flatnonzero(counts == k)
        bound[full] = np.maximum(bound[full], best[1][last[full]])
    return best


def _search(index: DataFrame, asks: DataFrame, pivots: np.ndarray, top2: int, dim: int, k: int, parts: int) -> DataFrame:
    """ask, vec_id, score: the best k of each visited slab part that reach the query's bound."""
    both = index.select("unit", F.lit(0).alias("side"), F.col("vec_id").alias("id"), "vec", F.col("dist").alias("x"), "pivot").unionByName(
        asks.select("unit", F.lit(1).alias("side"), F.col("ask").alias("id"), "vec", F.col("bound").alias("x"), F.lit(0).alias("pivot"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, ready = None, [], None
        for batch in batches:
            units, sides = batch.column("unit").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(units, prepend=units[:1]) != 0) | (np.diff(sides, prepend=sides[:1]) != 0)).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if hi == lo:
                    continue
                if units[lo] != unit:
                    unit, held, ready = units[lo], [], None
                piece = batch.slice(lo, hi - lo)
                if sides[lo] == 0:
                    held.append(piece)
                    continue
                if not held:
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held).sort_by("x")
                    p = pivots[table.column("pivot")[0].as_py()]
                    ready = (_unpack(table.column("vec").to_pylist(), dim), table.column("id").to_numpy(), table.column("x").to_numpy(), p)
                v, ids, dist, p = ready
                for at in range(0, piece.num_rows, _BLOCK):
                    block = piece.slice(at, _BLOCK)
                    q = _unpack(block.column("vec").to_pylist(), dim)
                    apart = _distances(np.column_stack([q.astype(np.float64), np.zeros(len(q))]), p[None, :])[:, 0]
                    who, score, found = _scan(q, block.column("x").to_numpy(), apart, v, ids, dist, top2, k)
                    yield pa.RecordBatch.from_arrays(
                        [block.column("id").take(pa.array(who)), pa.array(found, pa.int64()), pa.array(score, pa.int64())], ["ask", "vec_id", "score"]
                    )

    dealt = both.repartition(parts, "unit").sortWithinPartitions("unit", "side")
    return dealt.mapInArrow(work, "ask long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products, ties to the smaller id.

    Both inputs are as ``quantise`` gives them. Each row of ``queries`` asks for itself, and one row with its id and vector does not count.
    """
    spark = vectors.sparkSession
    copies = F.count(F.lit(1)).alias("copies")
    vectors = stage(vectors.groupBy("vec_id", "vec").agg(F.first("norm2").alias("norm2"), F.first("dim").alias("dim"), copies), "vectors")
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    indexed = vectors.withColumn("copy", rank).where(F.col("copy") <= k + 1).drop("copy")
    queries = stage(queries.groupBy("vec_id", "vec").agg(F.first("dim").alias("dim"), copies), "queries")
    facts = vectors.agg(F.max("norm2").alias("m"), F.max("dim").alias("d")).first()
    asked = queries.agg(F.max("dim").alias("d")).first()["d"]
    if facts["m"] is None or asked is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # The query's own vector may be among them.
    reach = k + 1
    top2, dim = facts["m"], max(facts["d"], asked)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec", "norm2").collect()
    points = _lift(_unpack([bytes(r["vec"]) for r in sample], dim), np.array([r["norm2"] for r in sample]), top2)
    centres = _fit_pivots(points, pivots)
    keyed = stage(_key_rows(indexed, centres, top2, dim), "keyed-vectors")
    width = max((keyed.agg(F.max("dist")).first()[0] or 0.0) / BINS, 1e-9) * (1 + 1e-9)
    bins = keyed.withColumn("bin", F.floor(F.col("dist") / width).cast("int"))
    counts = [(r["pivot"], r["bin"], r["n"]) for r in bins.groupBy("pivot", "bin").agg(F.count(F.lit(1)).alias("n")).collect()]
    layout = _Layout(counts, width)
    slabs = spark.createDataFrame(
        [(p, b, s, layout.parts[s]) for (p, b), s in layout.slab_of.items()], "pivot int, bin int, slab long, parts long"
    )
    unit = F.shiftleft("slab", 32) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    index = stage(bins.join(F.broadcast(slabs), ["pivot", "bin"]).select(unit.alias("unit"), "vec_id", "vec", "dist", "pivot"), "index")
    # Queries with equal vectors ask once; an id with several vectors asks once for each, so ids do not name the asks.
    asks = queries.select("vec").distinct().select("vec", F.monotonically_increasing_id().alias("ask"), F.lit(float("-inf")).alias("bound"))
    asks = stage(asks, "asks")
    parts = partitions_for(spark, 8 * dim * keyed.count(), 8 << 20)
    near = stage(_search(index, _ask(asks, centres, layout, top2, dim, first=True), centres, top2, dim, reach, parts), "near")
    bound = _kth(near, reach)
    bounded = asks.drop("bound").join(bound, "ask", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))).cast("double"))
    rest = _search(index, _ask(bounded, centres, layout, top2, dim, first=False), centres, top2, dim, reach, parts)
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    found = (
        near.unionByName(rest).withColumn("r", F.row_number().over(best)).where(F.col("r") <= reach)
        .groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    )
    entries = asks.join(found, "ask").select(F.col("vec").alias("asked"), F.explode("top").alias("t")).select("asked", "t.vec_id", "t.score").distinct()
    named = stage(_with_copies(entries, vectors, dim), "answers")
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("asked"), F.col("copies").alias("times")).join(named, "asked")
    itself = ((F.col("vec_id") == F.col("query_id")) & (F.col("vec") == F.col("asked"))).cast("long")
    left = own.withColumn("copies", F.col("copies") - itself).where("copies > 0")
    each = left.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    place = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    ranked = each.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")


def _with_copies(entries: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """asked, vec_id, score, vec, copies: the vectors behind each (id, score), with the number of their rows.

    An id with several vectors has those of them that give the score.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, v = (_unpack(batch.column(c).to_pylist(), dim) for c in ("asked", "vec"))
                yield batch.filter(pa.array((q * v).sum(axis=1) == batch.column("score").to_numpy()))

    both = entries.join(vectors.select("vec_id", "vec", "copies"), "vec_id").select("asked", "vec_id", "score", "vec", "copies")
    return both.mapInArrow(work, "asked binary, vec_id long, score long, vec binary, copies long")


def _kth(found: DataFrame, k: int) -> DataFrame:
    """ask, bound: the k-th best score of each ask, where there is one."""
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("ask", F.col("score").cast("double").alias("bound"))


_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.place, q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
  FROM v AS q JOIN v ON q.place <> v.place WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op9_topk_search", _SQL)
def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(read(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 50 = 0"))
