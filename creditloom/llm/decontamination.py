"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document that share a seed (a run of ``min_match`` words)
are compared by running Karp-Rabin greedy string tiling: look for common
runs of the present search length by rolling hashes, mark the longest
non-overlapping ones as tiles, shorten the search length, repeat down to
``min_match``. Tiles may lie in any order, so reordered passages are found too. An
item leaks into a document when the tiles cover at least ``coverage`` of its words.

Seeds of the benchmark go to the tasks in groups of at most ``GROUP_BYTES`` of
item text; a larger benchmark takes more passes over the documents, each exact.
Documents are never shuffled.

Words are runs of letters and digits in lower case. An item shorter than ``min_match`` is its own
seed. Rows: null or wordless documents hold no item; null or wordless
items leak nowhere; null ids stay; repeated documents and items are
reported each; ties of coverage go to the smallest item_id; empty tables give empty results or no leaks;
further columns are ignored (``keep_clean`` carries them along). Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import fresh, query, read
from creditloom.llm.textops import ALNUM, Words, chunks, gram_hashes, split_words, within_text

MIN_MATCH = 4
COVERAGE = 0.6
GROUP_BYTES = 8 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_KIND = "array<struct<item_id: bigint, coverage: double, tiles: array<struct<doc_word: int, item_word: int, length: int>>>>"
_ARROW = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("coverage", pa.float64()),
    ("tiles", pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())]))),
]))


def _words(column: pa.Array) -> Words:
    return split_words(pc.utf8_lower(pc.fill_null(column, "")), inner=ALNUM)


def _rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` values, each from the one before."""
    n = len(values) - size + 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(values) + 1, _BASE, dtype=np.uint64), dtype=np.uint64)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:-1], dtype=np.uint64)])
        # Compare at a common power: lift each run to the highest one.
        return (running[size:] - running[:-size]) * powers[len(values) - 1 - np.arange(n)]


def tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (item word, doc word, length): greedy, longest first, none overlapping.

    ``item`` and ``doc`` hold one number a word. Of equally long matches the
    first in the item, then the first in the document is taken.
    """
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    size = len(item)
    while size >= min_match and free_i.any():
        found = _matches(item, doc, free_i, free_d, size)
        for length, i, d in found:
            # Earlier tiles may have taken a part of it; what is left is found by a later round.
            if free_i[i : i + length].all() and free_d[d : d + length].all():
                free_i[i : i + length] = False
                free_d[d : d + length] = False
                tiles.append((i, d, length))
        if not found:
            if size == min_match:
                break
            size = max(min_match, size // 2)
    return tiles


def _matches(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """The longest free common runs of at least ``size`` words: (length, item word, doc word)."""
    if len(item) < size or len(doc) < size:
        return []
    at_i, at_d = (np.flatnonzero(np.convolve(f, np.ones(size, int), "valid") == size) for f in (free_i, free_d))
    if not len(at_i) or not len(at_d):
        return []
    # Both sides in one buffer, so that equal runs have equal hashes.
    hashes = _rolling(np.concatenate([item, doc]), size)
    own, other = hashes[at_i], hashes[len(item) + at_d]
    order = np.argsort(own, kind="stable")
    lo, hi = (np.searchsorted(own[order], other, side=s) for s in ("left", "right"))
    times = hi - lo
    d = np.repeat(at_d, times)
    i = at_i[order[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]]
    # Only starts of maximal matches: the words before differ or are taken.
    before = (i > 0) & (d > 0)
    before[before] = (item[i[before] - 1] == doc[d[before] - 1]) & free_i[i[before] - 1] & free_d[d[before] - 1]
    i, d = i[~before], d[~before]
    length = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + length[live], d[live] + length[live]
        fits = (a < len(item)) & (b < len(doc))
        fits[fits] = (item[a[fits]] == doc[b[fits]]) & free_i[a[fits]] & free_d[b[fits]]
        live = live[fits]
        length[live] += 1
    longest = length.max(initial=0)
    if longest < size:
        return []
    # Longest first: shorter ones wait until the longest are marked.
    best = length == longest
    return sorted(zip(length[best].tolist(), i[best].tolist(), d[best].tolist(), strict=True), key=lambda m: m[1:])


@dataclass
class _Seeds:
    """Seeds of one length: hashes in order, with item number and item word of each."""

    size: int
    hashes: np.ndarray
    item: np.ndarray
    word: np.ndarray
    filter: np.ndarray


def _seeds(words: Words, hashes: np.ndarray, min_match: int) -> list[_Seeds]:
    counts = np.diff(words.first)
    out = []
    for size in sorted({min(min_match, int(c)) for c in counts if c}):
        mine = counts >= min_match if size == min_match else counts == size
        at = within_text(words.first, size)
        item = np.searchsorted(words.first, at, side="right") - 1
        at, item = at[mine[item]], item[mine[item]]
        grams = gram_hashes(hashes, size)[at]
        order = np.argsort(grams, kind="stable")
        quick = np.zeros(1 << 22, bool)
        quick[grams >> np.uint64(42)] = True
        out.append(_Seeds(size, grams[order], item[order], (at - words.first[item])[order], quick))
    return out


def _leaks(words: Words, seeds: list[_Seeds], items: list, sizes: np.ndarray, item_hashes: list[np.ndarray], coverage: float, min_match: int) -> dict[int, list[dict]]:
    """For each text with leaks: its items with coverage and tiles."""
    hashes = words.hashes()
    docs, at, item, word, length = [], [], [], [], []
    for s in seeds:
        grams = gram_hashes(hashes, s.size)
        hit = np.flatnonzero(s.filter[grams >> np.uint64(42)])
        lo, hi = (np.searchsorted(s.hashes, grams[hit], side=x) for x in ("left", "right"))
        hit, lo, times = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        text = np.searchsorted(words.first, hit, side="right") - 1
        inside = hit + s.size <= words.first[text + 1]
        hit, lo, times, text = hit[inside], lo[inside], times[inside], text[inside]
        row = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        docs.append(np.repeat(text, times))
        at.append(np.repeat(hit, times))
        item.append(s.item[row])
        word.append(s.word[row])
        length.append(np.full(len(row), s.size))
    if not docs or not sum(map(len, docs)):
        return {}
    docs, at, item, word, length = map(np.concatenate, (docs, at, item, word, length))
    order = np.lexsort((at, item, docs))
    docs, at, item, word, length = docs[order], at[order], item[order], word[order], length[order]
    edges = np.flatnonzero((np.diff(docs, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
    out: dict[int, list[dict]] = {}
    for lo, hi in zip(edges, np.append(edges[1:], len(docs)), strict=True):
        k, doc = int(item[lo]), int(docs[lo])
        n = int(sizes[k])
        # Tiles lie within the words that seeds cover: too few of them settle the pair.
        reach = np.zeros(n + 1, np.int64)
        np.add.at(reach, word[lo:hi], 1)
        np.add.at(reach, word[lo:hi] + length[lo:hi], -1)
        need = math.ceil(coverage * n - 1e-9)
        if (np.cumsum(reach[:n]) > 0).sum() < need:
            continue
        # Only the document words that seeds cover can be part of a tile.
        first = words.first[doc]
        mark = np.zeros(words.first[doc + 1] - first + 1, np.int64)
        np.add.at(mark, at[lo:hi] - first, 1)
        np.add.at(mark, at[lo:hi] - first + length[lo:hi], -1)
        kept = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        gap = np.flatnonzero(np.diff(kept) > 1) + 1
        # A number that no item holds stands between separate stretches.
        place = np.insert(kept, gap, -1)
        doc_words = np.where(place >= 0, hashes[first + np.maximum(place, 0)], np.uint64(0))
        tiles = tile(item_hashes[k], doc_words, min(min_match, n))
        share = sum(t[2] for t in tiles) / n
        if share >= coverage - 1e-9:
            spans = [{"doc_word": int(place[d]), "item_word": i, "length": m} for i, d, m in tiles]
            out.setdefault(doc, []).append({"item_id": items[k], "coverage": share, "tiles": spans})
    return out


def tag_leaks(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, name: str = "leaks"
) -> DataFrame:
    """``docs`` (which needs ``text``) and a column of the items found in each text.

    ``name`` is an array of (item_id, coverage, tiles), by item; a tile has its first
    word in document and item, and its length.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    out = docs.withColumn(name, F.expr(f"cast(array() as {_KIND})"))
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text").toArrow().combine_chunks()
        if part.num_rows:
            out = out.mapInArrow(_tagger(part, min_match, coverage, name), out.schema)
    return out


def _tagger(part: pa.Table, min_match: int, coverage: float, name: str):
    ids, texts = part.column("item_id").to_pylist(), part.column("text").combine_chunks()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _words(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks))
        hashes = bench.hashes()
        seeds, sizes = _seeds(bench, hashes, min_match), np.diff(bench.first)
        each = [hashes[a:b] for a, b in zip(bench.first[:-1], bench.first[1:], strict=True)]
        for batch in chunks(batches):
            found = _leaks(_words(batch.column("text")), seeds, ids, sizes, each, coverage, min_match)
            leaks = batch.column(name)
            if found:
                before = leaks.to_pylist()
                leaks = pa.array([[*b, *found.get(k, ())] for k, b in enumerate(before)], _ARROW)
            columns = [leaks if c == name else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return work


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` (all columns) that hold no benchmark item."""
    name = fresh(docs, "leaks")
    return tag_leaks(docs, benchmark, name=name, **how).where(F.size(name) == 0).drop(name)


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = tag_leaks(docs, read(spark, sf_dir, "benchmark"))
    best = F.try_element_at(F.array_sort("leaks", lambda a, b: F.when(a["coverage"] != b["coverage"], F.signum(b["coverage"] - a["coverage"])).otherwise(F.signum(a["item_id"] - b["item_id"])).cast("int")), F.lit(1))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), best["item_id"].alias("item_id"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), F.array_sort(F.transform("leaks", lambda x: x["item_id"])).alias("item_ids"),
    )
