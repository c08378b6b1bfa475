"""SimHash near-duplicates by tiled exact comparison.

Each text gets a SimHash fingerprint over the hashes of its word shingles.
Equal fingerprints are one class from the start. Classes are cut into tiles;
two tiles are compared in full with numpy exclusive-or and bit counts unless
their population counts tell that no pair can lie within the radius.

* The tile key is the population count of each 16-bit quarter of the first
  fingerprint word: a pair within the radius differs by at most the radius in the
  sum of these counts, so a tile only meets tiles of such keys.
* With ``size_ratio`` the key is instead the logarithm of the number of distinct
  shingles: texts of similarity s have counts within a factor s of each other.

A key with many classes is cut into tiles of ``TILE`` rows; a unit of work is one
pair of tiles, so it is bounded whatever the data holds. A unit reports links
that span what it found connected (at most one a row), never all pairs.

With ``similarity`` classes are texts of equal shingle sets, and an exact prefix filter comes before the
tiles: in one order of all shingles, two sets of Jaccard similarity s share one of their
first ``n - ceil(s n) + 1`` shingles. The order is by hash, but shingles that are first in more than ``HOT``
classes come after all others, the rarer ones first; classes that hold one of them
are given their prefix anew from their whole text. A unit holds the classes that share one prefix shingle (more than
``TILE`` of them: two tiles of these). So copies follow the text, not the square of the classes, and a
passage that many texts hold brings nobody together. Classes that a unit found within the radius form a
group, named by its smallest class, whatever the unit. Each group is cut into tiles bounded in rows and
bytes, and two classes of it are linked only when they are within the radius and the Jaccard
similarity of their distinct shingles, counted out in full, reaches the value. Only candidates' shingles are shuffled.

The table of tile keys is broadcast; there are at most 17^4 keys (or a few hundred sizes).

Rows: null text counts as empty; texts without words share the fingerprint
zero and are linked like any other; null ids take part but are never a
component's name unless all its ids are null; repeated rows are copies; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import fresh, partitions_for, passing_tables, query, read, row_keys, stage
from creditloom.llm.components import smallest_reachable
from creditloom.llm.textops import chunks, mix, split_words

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Classes in a tile.
TILE = 2048
#: Classes that may have a shingle in their prefix before it counts as frequent.
HOT = 64
#: Classes and bytes of shingle hashes in a tile of candidates.
VERIFY_TILE = 1024
VERIFY_BYTES = 4 << 20

_SALTS = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D], dtype=np.uint64)


def _shingle_hashes(data: bytes, starts: list[int], ends: list[int], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words; a shorter text is one run."""
    if not starts:
        return np.empty(0, np.uint64)
    tail = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[s:e], seed) for s, e in zip(starts, tail, strict=False)], dtype=np.uint64)


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the bits set in over half of its hashes, as one unsigned number."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, first[:-1][full], axis=0, dtype=np.int32)
    over = (2 * sums > counts[full, None]).astype(np.uint8)
    out[full] = np.packbits(over, axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()
    return out


def _ordered(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes as signed numbers in the order of the prefix filter."""
    return np.sort(mix(hashes ^ _SALTS[3]).view(np.int64))


def _prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def fingerprints(
    docs: DataFrame, shingle: int = SHINGLE, words: int = 1, distinct: bool = False, seed: int = SEED, similarity: float | None = None
) -> DataFrame:
    """doc_id, row_key, row_key2, f0..f{words-1}, n_shingles: SimHash of 64 bits a word.

    A-Z count as a-z; all other characters stand for themselves. The first word
    uses XXH64 itself, later ones a remix of it. With ``distinct`` each
    shingle counts once. ``similarity`` adds ``set_key`` and ``set_key2``, hashes of the distinct shingles, and
    ``window``, the first of these in hash order: twice as many as similar sets must share one of.
    """
    names = [f"f{k}" for k in range(words)]
    key, key2 = row_keys()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = split_words(batch.column("text"), lower=True)
            data, s, e = found.text.tobytes(), found.start.tolist(), found.end.tolist()
            each = []
            for lo, hi in itertools.pairwise(found.first.tolist()):
                h = _shingle_hashes(data, s[lo:hi], e[lo:hi], shingle, seed)
                each.append(np.unique(h) if distinct else h)
            first = np.append(0, np.cumsum([len(h) for h in each]))
            hashes = np.concatenate(each) if each else np.empty(0, np.uint64)
            out = {c: batch.column(c) for c in ("doc_id", "row_key", "row_key2")}
            for k, name in enumerate(names):
                h = mix(hashes ^ _SALTS[k]) if k else hashes
                out[name] = pa.array(_majority(h, first).view(np.int64), pa.int64())
            out["n_shingles"] = pa.array(np.diff(first), pa.int64())
            if similarity is not None:
                sets = [h if distinct else np.unique(h) for h in each]
                for k, name in enumerate(("set_key", "set_key2")):
                    keys = [xxhash.xxh64_intdigest(h.tobytes(), seed + k) for h in sets]
                    out[name] = pa.array(np.array(keys, dtype=np.uint64).view(np.int64), pa.int64())
                windows = [_ordered(h)[: 2 * _prefix_length(len(h), similarity)] for h in sets]
                offsets = np.append(0, np.cumsum([len(x) for x in windows])).astype(np.int32)
                out["window"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(windows), pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, row_key long, row_key2 long, " + "".join(f"{n} long, " for n in names) + "n_shingles long"
    if similarity is not None:
        schema += ", set_key long, set_key2 long, window array<long>"
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), key.alias("row_key"), key2.alias("row_key2"))
    return given.mapInArrow(work, schema)


def _quarter_counts(f0: str = "f0"):
    """Population counts of the four quarters, five bits each."""
    return sum(
        F.bit_count(F.shiftrightunsigned(F.col(f0), 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") * F.lit(1 << 5 * k) for k in range(4)
    )


@functools.cache
def _steps(radius: int) -> list[tuple[int, ...]]:
    return [s for s in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius]


def _near_keys(key: int, radius: int) -> list[int]:
    """Keys at or below ``key`` whose quarter counts differ by at most ``radius`` in sum."""
    counts = [key >> 5 * k & 31 for k in range(4)]
    out = []
    for step in _steps(radius):
        moved = [c + d for c, d in zip(counts, step, strict=True)]
        if all(0 <= m <= 16 for m in moved):
            out.append(sum(m << 5 * k for k, m in enumerate(moved)))
    return sorted(k for k in out if k <= key)


def _homes(sizes: dict[int, int], radius: int, by_size: bool) -> dict[int, tuple[list[int], int, int]]:
    """For each key: the homes it visits as a guest, its own tiles, and the guest parts of its home."""
    visits = {k: [h for h in ([k - 1, k] if by_size else _near_keys(k, radius)) if h in sizes] for k in sizes}
    guests = dict.fromkeys(sizes, 0)
    for k, homes in visits.items():
        for h in homes:
            guests[h] += sizes[k]
    return {k: (visits[k], -(-sizes[k] // TILE), -(-guests[k] // (4 * TILE))) for k in sizes}


def _deal(classes: DataFrame, columns: list[str], radius: int, by_size: bool) -> DataFrame:
    """Rows (unit, side, ...) so that every near pair of classes meets in a unit of bounded size.

    Unit (home key, own tile, guest part) holds one tile of the home key's classes
    (side 0) and one part of the classes that are guests there (side 1).
    """
    sizes = {r["key"]: r["n"] for r in classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    homes = _homes(sizes, radius, by_size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            spread = mix(batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64) ^ _SALTS[1])
            rows, units, sides = [], [], []
            for key in np.unique(keys).tolist():
                at = np.flatnonzero(keys == key)
                visits, tiles, parts = homes[key]
                tile = (spread[at] % np.uint64(tiles)).astype(np.int64)
                for part in range(parts):
                    rows.append(at)
                    units.append(_unit(key, tile, part))
                    sides.append(np.zeros(len(at), np.int8))
                for home in visits:
                    _, own, cut = homes[home]
                    part = (spread[at] // np.uint64(1 << 20) % np.uint64(cut)).astype(np.int64)
                    for t in range(own):
                        # Inside one key a pair of tiles needs one of its two orders.
                        go = tile >= t if home == key else slice(None)
                        rows.append(at[go])
                        units.append(_unit(home, t, part[go]))
                        sides.append(np.ones(len(rows[-1]), np.int8))
            if rows:
                took = pa.Table.from_batches([batch.select(["node", *columns])]).take(pa.array(np.concatenate(rows))).combine_chunks()
                for out in took.to_batches():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(units)), pa.array(np.concatenate(sides)), *out.columns], ["unit", "side", "node", *columns]
                    )

    return classes.mapInArrow(work, "unit long, side byte, node long, " + ", ".join(f"{c} long" for c in columns))


def _unit(home: int, tile: int | np.ndarray, part: int | np.ndarray) -> np.ndarray:
    return (np.int64(home) << 44) + (np.asarray(tile, np.int64) << 22) + np.asarray(part, np.int64)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _compare(own: np.ndarray, guest: np.ndarray, prints: np.ndarray, sizes: np.ndarray, radius: int, ratio: float | None) -> np.ndarray:
    """Group label (the least row number) of each row of a unit: rows linked by near pairs of own and guest rows."""
    parent = np.arange(len(prints))
    weight = np.bitwise_count(prints).sum(axis=1, dtype=np.int32)
    own, guest = own[np.argsort(weight[own], kind="stable")], guest[np.argsort(weight[guest], kind="stable")]
    for a in range(0, len(own), 256):
        left = own[a : a + 256]
        # Only guests whose population count lies within the radius of this tile's counts.
        lo, hi = np.searchsorted(weight[guest], (weight[left[0]] - radius, weight[left[-1]] + radius + 1))
        for b in range(lo, hi, 1024):
            right = guest[b : min(b + 1024, hi)]
            apart = np.bitwise_count(prints[left, 0][:, None] ^ prints[right, 0][None, :])
            if prints.shape[1] > 1:
                apart += np.bitwise_count(prints[left, 1][:, None] ^ prints[right, 1][None, :])
            i, j = np.nonzero(apart <= radius)
            i, j = left[i], right[j]
            if prints.shape[1] > 2:
                # Few pairs are near in the first two words; only these are counted out.
                close = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int32) <= radius
                i, j = i[close], j[close]
            if ratio is not None:
                fits = np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j])
                i, j = i[fits], j[fits]
            # What earlier tiles have joined needs no second link.
            i, j = parent[i], parent[j]
            new = i != j
            for x, y in np.unique(np.stack([i[new], j[new]], axis=1), axis=0).tolist():
                x, y = _find(parent, x), _find(parent, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return np.array([_find(parent, x) for x in range(len(prints))], dtype=np.int64)


def _links(dealt: DataFrame, names: list[str], radius: int, ratio: float | None) -> DataFrame:
    """unit, a, b: links that span the near pairs of each unit. ``dealt`` is sorted by unit within partitions."""

    def unit_links(table: pa.Table) -> pa.RecordBatch | None:
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        if not (col["side"].any() and (col["side"] == 0).any()):
            return None
        prints = np.stack([col[n] for n in names], axis=1).view(np.uint64)
        label = _compare(np.flatnonzero(col["side"] == 0), np.flatnonzero(col["side"]), prints, col["n_shingles"], radius, ratio)
        a, b = col["node"], col["node"][label]
        linked = a != b
        columns = {"unit": pa.array(col["unit"][linked]), "a": pa.array(a[linked]), "b": pa.array(b[linked])}
        return pa.RecordBatch.from_pydict(columns) if linked.any() else None

    return dealt.mapInArrow(_by_unit(unit_links), "unit long, a long, b long")


def _by_unit(links: Callable[[pa.Table], pa.RecordBatch | None]):
    """Applies ``links`` to the rows of each unit; rows come sorted by unit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            unit = batch.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
            for lo, hi in itertools.pairwise(cuts):
                if held and hi > lo and held[-1].column("unit")[0].as_py() != unit[lo]:
                    if (out := links(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held and (out := links(pa.Table.from_batches(held))) is not None:
            yield out

    return work


def _shingle_sets(rows: DataFrame, names: list[str], shingle: int, seed: int = SEED, ordered: bool = False) -> DataFrame:
    """node, fingerprint words, n_shingles and the distinct shingle hashes of each text; ``ordered``: as numbers of the prefix filter's order."""
    kept = ["node", *names, "n_shingles"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = split_words(batch.column("text"), lower=True)
            data, s, e = found.text.tobytes(), found.start.tolist(), found.end.tolist()
            sets = [
                np.unique(_shingle_hashes(data, s[lo:hi], e[lo:hi], shingle, seed)).tobytes() for lo, hi in itertools.pairwise(found.first.tolist())
            ]
            if ordered:
                column = pa.array([_ordered(np.frombuffer(b, dtype=np.uint64)) for b in sets], pa.list_(pa.int64()))
            else:
                column = pa.array(sets, pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, "shingles"])

    return rows.select(*kept, "text").mapInArrow(work, ", ".join(f"{c} long" for c in kept) + (", shingles array<long>" if ordered else ", shingles binary"))


def _same(prints: np.ndarray, sets: list[np.ndarray], tile: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Group label of each row: rows of different tiles (of one, if there is one) linked where the sets' Jaccard similarity reaches the value."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    first = np.append(0, np.cumsum(sizes))
    kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(kinds), dtype=bool)
    label = np.arange(len(sets))
    one = (tile == tile[0]).all()
    for x in range(len(sets)):
        other = np.arange(x + 1, len(sets)) if one else np.flatnonzero(tile > tile[x])
        other = other[label[other] != label[x]]
        least, most = np.minimum(sizes[other], sizes[x]), np.maximum(sizes[other], sizes[x])
        other = other[(least >= similarity * most - 1e-9) & (sizes[other] > 0)]
        other = other[np.bitwise_count(prints[other] ^ prints[x]).sum(axis=1, dtype=np.int32) <= radius]
        if not len(other):
            continue
        mark[ids[first[x] : first[x + 1]]] = True
        shared = np.array([np.count_nonzero(mark[ids[first[y] : first[y + 1]]]) for y in other.tolist()], dtype=np.int64)
        mark[ids[first[x] : first[x + 1]]] = False
        near = other[shared >= similarity * (sizes[other] + sizes[x] - shared) - 1e-9]
        joined = np.unique(np.append(label[near], label[x]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def _texts_of(docs: DataFrame, classes: DataFrame, kept: list[str]) -> DataFrame:
    """node, ``kept`` columns and the text of the first row of each class."""
    key, key2 = fresh(docs, "row_key"), fresh(docs, "row_key2")
    # Written, so that its size is known when the join is planned.
    asked = stage(classes.select("node", F.col("least.row_key").alias(key), F.col("least.row_key2").alias(key2), *kept), "asked-texts")
    a, b = row_keys()
    return docs.select(F.col("text").cast("string").alias("text"), a.alias(key), b.alias(key2)).join(asked, [key, key2]).dropDuplicates(["node"])


def _prefixes(docs: DataFrame, prints: DataFrame, classes: DataFrame, names: list[str], shingle: int, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """node, s: the prefix shingles of each class that are not frequent; and node, s, c: those that are, with their counts, if there are any.

    Frequent shingles come last in order. Windows meet the frequent shingles once, and their classes once: a join with either
    moves all of them as soon as Spark no longer broadcasts the other side.
    """
    n = F.col("n_shingles")
    length = (n - F.ceil(n * F.lit(similarity) - F.lit(1e-9)) + 1).cast("int")
    firsts = classes.select("node", F.col("least.row").alias("row"))
    windows = prints.select("row", "n_shingles", "window").join(firsts, "row").where("n_shingles > 0").select("node", length.alias("length"), "window")
    # Written, so that the windows of the classes are shuffled once and not for every count below.
    windows = stage(windows, "windows")
    entries = windows.select("node", "length", F.posexplode("window").alias("place", "s")).select("node", "s", (F.col("place") < F.col("length")).alias("early"))
    # What follows a prefix in order takes the place of the frequent shingles in it, so it is counted as well.
    counts = entries.groupBy("s").agg(F.sum(F.col("early").cast("long")).alias("early"), F.count(F.lit(1)).alias("all"))
    counts = counts.select("s", F.greatest("early", F.col("all") - F.col("early")).alias("c"))
    hot = stage(counts.where(F.col("c") > HOT), "frequent-shingles")
    first = F.slice("window", F.lit(1), F.col("length"))
    if not hot.limit(1).count():
        return windows.select("node", F.explode(first).alias("s")), None

    # Any set of frequent shingles gives one order, as long as all classes whose prefix it changes are given theirs anew.
    hits = entries.join(hot, "s").groupBy("node").agg(F.collect_list("s").alias("hits"), F.max("early").alias("changed")).where("changed")
    both = windows.join(hits.select("node", "hits"), "node", "left").withColumn("rare", F.array_except("window", "hits"))
    rare = both.select(
        "node", F.when(F.col("hits").isNull(), first).otherwise(F.slice("rare", F.lit(1), F.col("length"))).alias("rare"),
        (F.col("hits").isNull() | (F.size("rare") >= F.col("length"))).alias("full"),
    )
    rare = stage(rare, "rare-shingles")
    # Texts that are mostly frequent shingles: those count from the rarest on, over the whole text.
    texts = _texts_of(docs, classes.join(rare.where("not full").select("node"), "node", "left_semi"), [*names, "n_shingles"])
    each = _shingle_sets(texts, names, shingle, ordered=True).select("node", "n_shingles", F.explode("shingles").alias("s")).join(hot, "s", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0).cast("long")).alias("c"), "s")))
    rest = each.groupBy("node", "n_shingles").agg(order.alias("order")).select("node", F.explode(F.slice("order", F.lit(1), length)).alias("e"))
    rest = stage(rest.select("node", "e.s", "e.c"), "ordered-shingles")
    # Only these classes keep a frequent shingle in their prefix.
    postings = rare.where("full").select("node", F.explode("rare").alias("s")).unionByName(rest.where("c = 0").select("node", "s"))
    return postings, rest.where("c > 0")


def _units(postings: DataFrame) -> DataFrame:
    """unit, node: the classes that share a prefix shingle, two or more; shingles with the same classes make one unit.

    A shingle's classes beyond ``TILE`` are cut into tiles, and each two of these make a unit.
    """

    def unit_rows(nodes: np.ndarray) -> Iterator[np.ndarray]:
        tiles = -(-len(nodes) // TILE)
        if tiles == 1:
            yield nodes
            return
        tile = (mix(nodes.view(np.uint64) ^ _SALTS[1]) % np.uint64(tiles)).astype(np.int64)
        for a, b in itertools.combinations_with_replacement(range(tiles), 2):
            if a < b:
                yield nodes[(tile == a) | (tile == b)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            nodes = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
            if len(nodes) > 1:
                for rows in unit_rows(nodes):
                    unit = xxhash.xxh64_intdigest(rows.tobytes(), SEED) - (1 << 63)
                    if unit not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(unit)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), unit, np.int64)), pa.array(rows)], ["unit", "node"])

        for batch in batches:
            s, node = batch.column("s").to_numpy(), batch.column("node").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
            if last is not None and len(s) and s[0] != last:
                yield from close()
                held = []
            sizes = np.diff(cuts)
            for k in np.flatnonzero(sizes > 1).tolist() if len(s) else ():
                if 0 < k < len(sizes) - 1:
                    # A whole group inside the batch.
                    before, held = held, [node[cuts[k] : cuts[k + 1]]]
                    yield from close()
                    held = before
            if len(s):
                if len(sizes) == 1:
                    held.append(node)
                else:
                    held.append(node[: cuts[1]])
                    yield from close()
                    held = [node[cuts[-2] :]]
                last = s[-1]
        yield from close()

    return postings.mapInArrow(work, "unit long, node long")


def _candidates(postings: DataFrame, often: DataFrame | None, classes: DataFrame, names: list[str], radius: int, similarity: float) -> DataFrame:
    """a, b: classes within the radius that share a prefix shingle, each tied to the least class of its unit's group."""
    spark = postings.sparkSession
    parts = partitions_for(spark, 16 * (classes.agg(F.sum("n_shingles")).first()[0] or 0) / 4, 32 << 20)
    rows = _units(postings.repartition(parts, "s").sortWithinPartitions("s"))
    if often is not None:
        # Few classes keep a frequent shingle in their prefix; their tiles follow its count.
        often = often.withColumn("tiles", F.ceil(F.col("c") / TILE).cast("int"))
        tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        often = often.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        often = often.select(F.xxhash64("s", F.least("tile", "other"), F.greatest("tile", "other")).alias("unit"), "node")
        rows = rows.unionByName(often)
    rows = stage(rows.distinct(), "shared-shingles")
    dealt = rows.join(classes.select("node", *names, "n_shingles"), "node")

    def unit_links(table: pa.Table) -> pa.RecordBatch | None:
        if table.num_rows < 2:
            return None
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        order = np.argsort(col["node"], kind="stable")  # so that a group is named by its least class
        prints = np.stack([col[n][order] for n in names], axis=1).view(np.uint64)
        every = np.arange(len(order))
        label = _compare(every, every, prints, col["n_shingles"][order], radius, similarity)
        a = col["node"][order]
        b = a[label]
        linked = a != b
        return pa.RecordBatch.from_pydict({"a": pa.array(a[linked]), "b": pa.array(b[linked])}) if linked.any() else None

    parts = partitions_for(spark, rows.count() * 64, 16 << 20)
    return dealt.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_by_unit(unit_links), "a long, b long").distinct()


def _verified(docs: DataFrame, classes: DataFrame, near: DataFrame, names: list[str], shingle: int, radius: int, similarity: float) -> DataFrame:
    """a, b: links that span the pairs of the groups in ``near`` that are of the similarity."""
    spark = docs.sparkSession
    members = near.select(F.col("b").alias("part"), F.explode(F.array("a", "b")).alias("node")).distinct()
    members = stage(members.join(classes.select("node", "n_shingles"), "node"), "candidates")
    asked = classes.join(members.select("node"), "node", "left_semi")
    sets = stage(_shingle_sets(_texts_of(docs, asked, [*names, "n_shingles"]), names, shingle), "shingle-sets")
    rows, size = F.count(F.lit(1)), 8 * F.sum("n_shingles")
    tiles = F.ceil(F.greatest(rows / VERIFY_TILE, size / VERIFY_BYTES, F.lit(1.0))).cast("int")
    counts = stage(members.groupBy("part").agg(tiles.alias("tiles"), size.alias("bytes")), "candidate-groups")
    total = counts.agg(F.sum(F.col("tiles") * F.col("bytes"))).first()[0] or 0
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = (
        members.join(counts, "part").select("part", "node", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .select(F.xxhash64("part", F.least("tile", "other"), F.greatest("tile", "other")).alias("unit"), "tile", "node")
        .join(sets, "node")
    )

    def unit_links(table: pa.Table) -> pa.RecordBatch | None:
        col = {c: table.column(c).to_numpy() for c in ("node", "tile", *names)}
        prints = np.stack([col[n] for n in names], axis=1).view(np.uint64)
        hashes = [np.frombuffer(b, dtype=np.uint64) for b in table.column("shingles").to_pylist()]
        label = _same(prints, hashes, col["tile"], radius, similarity)
        a, b = col["node"], col["node"][label]
        linked = a != b
        return pa.RecordBatch.from_pydict({"a": pa.array(a[linked]), "b": pa.array(b[linked])}) if linked.any() else None

    parts = partitions_for(spark, total, 8 << 20)
    return dealt.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_by_unit(unit_links), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    words: int = 1,
    distinct: bool = False,
    size_ratio: float | None = None,
    similarity: float | None = None,
) -> DataFrame:
    """doc_id, row_key, row_key2, f0.., n_shingles, node, component_id, first_row, first_row2 for every row of ``docs``.

    ``first_row`` and ``first_row2`` are the keys of the component's first row by (doc_id, nulls last, keys);
    ``component_id`` is the smallest doc_id reachable over fingerprints at most
    ``radius`` bits apart. ``size_ratio`` also asks that the smaller text has at
    least that share of the larger one's shingles. ``similarity`` also asks for that Jaccard
    similarity of the distinct shingles (and implies the size ratio). Fingerprints and
    links live in staged tables; only tile-key counts reach the driver.
    """
    spark = docs.sparkSession
    names = [f"f{k}" for k in range(words)]
    exact = similarity is not None
    if exact and (not distinct or not 0 < similarity < 1):
        raise ValueError("a similarity between 0 and 1 needs distinct shingles")
    by_size = size_ratio is not None
    prints = stage(fingerprints(docs, shingle, words, distinct, similarity=similarity).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    # Texts to verify are one class if their shingles are the same, others if their fingerprints are.
    same = ["set_key", "set_key2"] if exact else [*names, "n_shingles"] if by_size else names
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key", "row_key2", "row"))
    classes = prints.groupBy(*same).agg(least.alias("least"), *[F.first(n).alias(n) for n in [*names, "n_shingles"] if n not in same])
    # One word is its own name; other classes are numbered when they are written.
    classes = stage(classes.withColumn("node", F.col(names[0]) if same == names[:1] else F.monotonically_increasing_id()), "classes")
    if exact:
        ratio = max(size_ratio or 0.0, similarity)
        postings, often = _prefixes(docs, prints, classes, names, shingle, similarity)
        near = stage(_candidates(postings, often, classes, names, radius, ratio), "near-pairs")
        links = _verified(docs, classes, near, names, shingle, radius, similarity)
    else:
        key = (
            F.when(F.col("n_shingles") > 0, F.floor(F.log(F.greatest("n_shingles", F.lit(1))) / -math.log(size_ratio)) + 2).otherwise(0)
            if by_size
            else _quarter_counts()
        )
        dealt = _deal(classes.withColumn("key", key.cast("long")), [*names, "n_shingles"], radius, by_size)
        parts = partitions_for(spark, classes.count() * 24 * 40)
        links = _links(dealt.repartition(parts, "unit").sortWithinPartitions("unit"), names, radius, size_ratio)
    roots = smallest_reachable(links, "a", "b")
    rooted = classes.join(roots, "node", "left").select("node", *same, "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("least")).select(
        "root", F.col("least.doc_id").alias("component_id"), F.col("least.row_key").alias("first_row"), F.col("least.row_key2").alias("first_row2")
    )
    named = stage(rooted.drop("least").join(named, "root").select("node", *same, "component_id", "first_row", "first_row2"), "components")
    kept = ["doc_id", "row_key", "row_key2", *names, "n_shingles", *(c for c in same if c not in (*names, "n_shingles"))]
    return prints.select(*kept).join(named, same)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` (all columns) that stay: of each group exactly the first by (doc_id, nulls last, row keys).

    Rows with the same id stay apart unless their texts are copies; rows without an id are grouped like any other.
    """
    marks = [fresh(docs, "first_row"), fresh(docs, "first_row2")]
    # Only the keys of the rows that stay are needed further: fingerprints, windows, pairs and links go.
    with passing_tables(docs.sparkSession):
        found = near_duplicates(docs, **how)
        firsts = found.select(*[F.col(c).alias(m) for c, m in zip(("first_row", "first_row2"), marks, strict=True)]).distinct()
        firsts = stage(firsts, "first-rows", keep=True)
    kept = docs.withColumns(dict(zip(marks, row_keys(), strict=True))).join(firsts, marks, "left_semi")
    return kept.dropDuplicates(marks).drop(*marks)


@query("op7_simhash_dedup")
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
