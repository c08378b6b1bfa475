"""Exact substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one text. Every window has a
minimiser: the smallest hash among its runs of ``gram`` words. Consecutive
windows with the same minimiser overlap almost wholly, so they travel together
as one packed string (a super-k-mer) to the bucket of their minimiser. Equal
windows have equal minimisers and so meet in one bucket, where their word
sequences themselves are sorted and counted: hashes choose the bucket, they
never decide equality inside it.

A minimiser that a large share of the corpus holds would overfill its bucket.
A first pass counts windows per bucket; a bucket above ``HEAVY`` times the mean
is dealt to several shards. Windows that are single in their shard are then
compared across the shards of their bucket by a 128-bit digest, of which each
shard sends at most one row a window.

Rows: null or short text has no window and loses nothing; null ids are
ids of their own; repeated rows count as further places of the same text, so
all of them lose their repeated words; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import fresh, partitions_for, query, read, row_key, stage, text_size
from creditloom.llm.textops import Words, chunks, gram_hashes, sliding_min, split_words

WINDOW = 35
GRAM = 4
#: Packed text a bucket should hold, and packed bytes a scattering task keeps back.
BUCKET_BYTES = 16 << 20
FLUSH_BYTES = 10 << 20
#: A bucket is dealt to shards above this multiple of the mean.
HEAVY = 3

_SMALL = 512


def _runs(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of a chunk: text, first window, number of windows, minimiser."""
    counts = np.diff(words.first)
    grams = gram_hashes(words.hashes(), gram)
    lows = sliding_min(grams, window - gram + 1)
    n = np.maximum(counts - window + 1, 0)
    total = int(n.sum())
    if not total:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    at = np.repeat(words.first[:-1] - (np.cumsum(n) - n), n) + np.arange(total)
    low = lows[at]
    head = np.empty(total, dtype=bool)
    head[0] = True
    head[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(head)
    return text[start], at[start], np.diff(np.append(start, total)), low[start]


def _bucket(low: np.ndarray, buckets: int) -> np.ndarray:
    return ((low >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _bucket_sizes(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(buckets, dtype=np.int64)
        for batch in chunks(batches):
            _, _, n, low = _runs(split_words(batch.column("text")), window, gram)
            sizes += np.bincount(_bucket(low, buckets), weights=n + window, minlength=buckets).astype(np.int64)
        full = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int64()), "n": pa.array(sizes[full], pa.int64())})

    return docs.select("text").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _heavy_shards(sizes: DataFrame) -> dict[int, int]:
    """Shards of the buckets above HEAVY times the mean: at most one bucket in HEAVY can be."""
    total = sizes.agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("k")).first()
    if not total["s"]:
        return {}
    mean = total["s"] / total["k"]
    return {r["bucket"]: int(-(-r["n"] // mean)) for r in sizes.where(F.col("n") > HEAVY * mean).collect()}


def _pack(strings: list[bytes]) -> bytes:
    data = b"\n".join(strings)
    return b"\x00" + data if len(data) < _SMALL else b"\x01" + zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(blob: bytes) -> list[bytes]:
    data = blob[1:] if blob[:1] == b"\x00" else zstandard.ZstdDecompressor().decompress(blob[1:])
    return data.split(b"\n")


def _scatter(docs: DataFrame, buckets: int, shards: dict[int, int], window: int, gram: int) -> tuple[DataFrame, int]:
    """Packed super-k-mers with their places, one row per task, flush and bucket shard."""
    first_extra, extra = {}, buckets
    for b in sorted(shards):
        first_extra[b] = extra
        extra += shards[b] - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(lambda: [[], [], [], [], []])
        kept = 0
        shard_count = np.ones(buckets, dtype=np.int64)
        shard_base = np.zeros(buckets, dtype=np.int64)
        for b, s in shards.items():
            shard_count[b], shard_base[b] = s, first_extra[b]

        def flush() -> pa.RecordBatch:
            parts = sorted(held)
            cols = [held[p] for p in parts]
            return pa.RecordBatch.from_pydict({
                "part": pa.array(parts, pa.int32()),
                "heavy": pa.array([p >= buckets or p in shards for p in parts], pa.bool_()),
                "strings": pa.array([_pack(c[0]) for c in cols], pa.binary()),
                "ids": pa.array([np.array(c[1], dtype=np.int64).tobytes() for c in cols], pa.binary()),
                "keys": pa.array([np.array(c[2], dtype=np.int64).tobytes() for c in cols], pa.binary()),
                "starts": pa.array([np.array(c[3], dtype=np.int32).tobytes() for c in cols], pa.binary()),
                "lows": pa.array([np.array(c[4], dtype=np.uint32).tobytes() for c in cols], pa.binary()),
            })

        for batch in chunks(batches):
            words = split_words(batch.column("text"))
            text, at, n, low = _runs(words, window, gram)
            if not len(text):
                continue
            part = _bucket(low, buckets)
            key = batch.column("rk").to_numpy(zero_copy_only=False)[text]
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)[text]
            start = at - words.first[text]
            shard = (key.astype(np.uint64) ^ low) % shard_count[part].astype(np.uint64)
            part = np.where(shard == 0, part, shard_base[part] + shard.astype(np.int64) - 1)
            low = (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            data = words.text.tobytes()
            begin, end = words.start[at], words.end[at + n + window - 2]
            kept += int((end - begin).sum())
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order], prepend=-1))
            b_, e_ = begin.tolist(), end.tolist()
            for lo, hi in zip(edges, np.append(edges[1:], len(order)), strict=True):
                rows = order[lo:hi]
                cell = held[int(part[rows[0]])]
                cell[0] += [data[b_[r] : e_[r]] for r in rows.tolist()]
                cell[1] += ids[rows].tolist()
                cell[2] += key[rows].tolist()
                cell[3] += start[rows].tolist()
                cell[4] += low[rows].tolist()
            if kept > FLUSH_BYTES:
                yield flush()
                held.clear()
                kept = 0
        if held:
            yield flush()

    schema = "part int, heavy boolean, strings binary, ids binary, keys binary, starts binary, lows binary"
    return docs.select("doc_id", "text", "rk").mapInArrow(work, schema), extra


def _word_slices(string: bytes, window: int) -> list[bytes]:
    """Every window of a packed string, as bytes."""
    cut = [-1, *np.flatnonzero(np.frombuffer(string, dtype=np.uint8) == 0x20).tolist(), len(string)]
    return [string[cut[k] + 1 : cut[k + window]] for k in range(len(cut) - window)]


def _repeats_inside(string: bytes, n: int, window: int) -> bool:
    """Whether a packed string of n windows holds one of them twice."""
    if n == 1 or len(set(string.split(b" ", n)[:n])) == n:  # windows that start differently differ
        return False
    return len(set(_word_slices(string, window))) < n


def _ranges(flags: list[bool] | np.ndarray, window: int) -> list[tuple[int, int]]:
    """Words covered by flagged windows, as half-open ranges."""
    at = np.flatnonzero(np.asarray(flags, dtype=bool))
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.append(0, gap + 1)].tolist(), (at[np.append(gap, len(at) - 1)] + window).tolist(), strict=True))


def _count_buckets(packed: DataFrame, parts: int, window: int) -> DataFrame:
    """Covered ranges of repeated windows; in shards also one row for each window to compare further."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, dict[bytes, list]] = defaultdict(dict)
        heavy = False
        for batch in batches:
            for row in batch.to_pylist():
                heavy |= row["heavy"]
                places = zip(
                    np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["keys"], np.int64).tolist(),
                    np.frombuffer(row["starts"], np.int32).tolist(), strict=True,
                )
                lows = np.frombuffer(row["lows"], np.uint32).tolist()
                for string, low, place in zip(_unpack(row["strings"]), lows, places, strict=True):
                    groups[low].setdefault(string, []).append(place)
        out: list[tuple] = []
        for group in groups.values():
            strings = list(group.items())
            if not heavy and len(strings) == 1:
                string, places = strings[0]
                n = string.count(b" ") + 2 - window
                if not _repeats_inside(string, n, window):
                    if len(places) > 1:
                        out += [(k, i, s, s + n + window - 1, None, None) for i, k, s in places]
                        if len(out) > 20_000:
                            yield _rows(out)
                            out = []
                    continue
            # Sorted windows: equal sequences stand together, a run's weight is its number of places.
            found = [(w, j, k) for j, (string, _) in enumerate(strings) for k, w in enumerate(_word_slices(string, window))]
            found.sort()
            flags = [bytearray(string.count(b" ") + 2 - window) for string, _ in strings]
            at = 0
            while at < len(found):
                to, weight = at, 0
                while to < len(found) and found[to][0] == found[at][0]:
                    weight += len(strings[found[to][1]][1])
                    to += 1
                if weight > 1:
                    for _, j, k in found[at:to]:
                        flags[j][k] = 1
                if heavy:
                    digest = xxhash.xxh128_intdigest(found[at][0])
                    high, low_ = digest >> 64, digest & (1 << 64) - 1
                    _, j, k = found[at]
                    i, key, s = strings[j][1][0]
                    # A window that is repeated here needs no place: it only tells the other shards.
                    out.append((None if weight > 1 else key, i, s + k, s + k + window, _signed(high), _signed(low_)))
                at = to
            for (_, places), flag in zip(strings, flags, strict=True):
                for lo, hi in _ranges(flag, window):
                    out += [(key, i, s + lo, s + hi, None, None) for i, key, s in places]
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return packed.repartitionById(parts, "part").mapInArrow(work, "rk long, doc_id long, lo int, hi int, d1 long, d2 long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    names = ("rk", "doc_id", "lo", "hi", "d1", "d2")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """rk, doc_id, lo, hi: word ranges covered by windows that start at two or more places (null ids as 0).

    ``docs`` needs ``doc_id``, ``text`` and ``rk`` (``common.row_key``). Ranges of one
    row may overlap. Intermediate results are a staged table, so a lost executor
    costs a re-read.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and the window")
    spark = docs.sparkSession
    buckets = partitions_for(spark, 3 * text_size(docs), BUCKET_BYTES)
    shards = _heavy_shards(_bucket_sizes(docs, buckets, window, gram))
    packed, parts = _scatter(docs, buckets, shards, window, gram)
    found = stage(_count_buckets(packed, parts, window), "repeated-windows")
    sure = found.where(F.col("d1").isNull()).select("rk", "doc_id", "lo", "hi")
    # Each shard sends a window once, so a group holds no more rows than there are shards.
    across = (
        found.where(F.col("d1").isNotNull())
        .groupBy("d1", "d2")
        .agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("rk").isNotNull(), F.struct("rk", "doc_id", "lo", "hi"))).alias("places"))
        .where("n > 1")
        .select(F.explode("places").alias("p"))
        .select("p.rk", "p.doc_id", "p.lo", "p.hi")
    )
    return sure.unionByName(across)


def _stripper(text: str, ranges: str):
    """Batches with the column ``ranges`` replaced by the text that is left and counts of words and removed words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            words = split_words(batch.column(text))
            counts = np.diff(words.first)
            removed = np.zeros(len(counts), dtype=np.int64)
            data, kept = words.text.tobytes(), []
            for i, found in enumerate(batch.column(ranges).to_pylist()):
                first, n = words.first[i], int(counts[i])
                if not n:
                    kept.append("")
                    continue
                if not found:
                    kept.append(data[words.start[first] : words.end[first + n - 1]].decode())
                    continue
                step = np.zeros(n + 1, dtype=np.int32)
                np.add.at(step, [r["lo"] for r in found], 1)
                np.add.at(step, [r["hi"] for r in found], -1)
                gone = np.cumsum(step[:-1]) > 0
                removed[i] = gone.sum()
                edge = np.flatnonzero(np.diff(np.concatenate(([1], gone, [1]))))
                spans = [data[words.start[first + a] : words.end[first + b - 1]] for a, b in zip(edge[::2], edge[1::2], strict=True)]
                kept.append(b" ".join(spans).decode())
            left = pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept_text"]
            )
            columns = [left if c == ranges else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return work


def tag_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, name: str = "left") -> DataFrame:
    """``docs`` (which needs doc_id and text) and a struct of n_words, n_removed and kept_text.

    Kept words are joined by one space. Every place of a repeated window goes,
    the first one too; windows are judged on the input.
    """
    key, other, owner = (fresh(docs, c) for c in ("rk", "rk_of_ranges", "id_of_ranges"))
    keyed = docs.withColumn(key, row_key())
    found = repeated_ranges(keyed.select(F.col("doc_id").cast("long"), "text", F.col(key).alias("rk")), window, gram)
    ranges = found.groupBy(F.col("rk").alias(other), F.col("doc_id").alias(owner)).agg(F.collect_list(F.struct("lo", "hi")).alias(name))
    # The id beside the digest: two documents never share a key.
    same = (F.col(key) == F.col(other)) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == F.col(owner))
    joined = keyed.join(ranges, same, "left").drop(key, other, owner)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_stripper("text", name), f"{schema}, `{name}` struct<n_words: bigint, n_removed: bigint, kept_text: string>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of each text; see ``tag_repeats``."""
    found = tag_repeats(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), window, gram)
    return found.select("doc_id", "left.n_words", "left.n_removed", "left.kept_text")


def strip_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows of ``docs`` (all columns) with their repeated passages taken out of ``text``.

    A text that loses nothing stays as it is; one of which nothing is left goes.
    ``n_chars``, where there is one, follows the text.
    """
    name = fresh(docs, "left")
    found = tag_repeats(docs, window, gram, name)
    left = F.col(name)
    found = found.where((left["n_removed"] == 0) | (left["n_removed"] < left["n_words"]))
    found = found.withColumn("text", F.when(left["n_removed"] > 0, left["kept_text"]).otherwise(F.col("text"))).drop(name)
    if "n_chars" in found.columns:
        found = found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return found


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
