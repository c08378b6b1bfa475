"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words in which words ``q`` apart are identical, ``q`` is the
smallest such period, the period fits in at least three times, and no
neighbouring word carries it on.

For each power of two ``L`` every stretch of ``L`` words that occurs again in its text
gets a name: the pair of the names of its halves. The next occurrence of a name
within ``L`` words proposes its distance ``d`` as a period; level ``L`` answers for the
periods in (L / 2, L].

* Inside a run of period ``q <= L`` the occurrences of a stretch of ``L`` words form an
  arithmetic progression with the difference ``q``: a nearer one would give a smaller
  period (Fine and Wilf).
* So the proposals of one run are its consecutive starts, all with distance ``q``, and two
  starts at least, as ``q + L < 3 q``. Joined, they reach from the first word of the run to its last:
  each run appears once, in full length.

A stretch that occurs once can be part of no longer one that occurs twice, so only
repeated stretches go on to the next level, and levels end when none is left. Names are exact: words are
numbered by their bytes, stretches by pairs of names; nothing is hashed into a name.

Rows: null text counts as empty (no words, no runs, empty text); null ids stay; repeated rows
are worked on each; empty tables give empty results; a text of any length is searched whole;
further columns are ignored. One pass, no shuffle: a task holds one chunk of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import query, read
from creditloom.llm.textops import Words, chunks, split_words, word_numbers

MIN_LENGTH = 24
MIN_REPEATS = 3


def runs_of(names: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; text i has the words ``first[i]:first[i + 1]``."""
    if min_repeats < MIN_REPEATS:
        raise ValueError("periods are proposed for runs of three repeats or more")
    n, counts = len(names), np.diff(first)
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    longest = int(counts.max(initial=0))
    at, names, found, size = np.arange(n), names, [], 1
    while len(at) and min_repeats * (size // 2 + 1) <= longest:
        order = np.argsort(names, kind="stable")
        place, names = at[order], names[order]
        again = (names[1:] == names[:-1]) & (text[place[1:]] == text[place[:-1]])
        step = place[1:] - place[:-1]
        found.append(_joined(place[:-1], step, again & (2 * step > size) & (step <= size), size))
        # Only stretches that occur more than once in their text get a name.
        kept = np.zeros(len(place), dtype=bool)
        kept[1:] = again
        kept[:-1] |= again
        new = np.append(True, ~again)
        name_at = np.full(n, -1, dtype=np.int64)
        name_at[place[kept]] = np.cumsum(new)[kept]
        at = np.flatnonzero(name_at >= 0)
        at = at[at + 2 * size <= first[1:][text[at]]]
        at = at[name_at[at + size] >= 0]
        names = name_at[at] * np.int64(len(place) + 1) + name_at[at + size]
        size *= 2
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    runs = runs[runs[:, 1] >= np.maximum(min_length, min_repeats * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _joined(place: np.ndarray, step: np.ndarray, proposed: np.ndarray, size: int) -> np.ndarray:
    """(start, length, period) of each row of consecutive starts with one proposed period."""
    start, period = place[proposed], step[proposed]
    order = np.argsort(start)
    start, period = start[order], period[order]
    heads = np.ones(len(start), dtype=bool)
    heads[1:] = (start[1:] != start[:-1] + 1) | (period[1:] != period[:-1])
    head = np.flatnonzero(heads)
    last = np.append(head[1:], len(start)) - 1 if len(head) else head
    return np.stack([start[head], start[last] - start[head] + period[head] + size, period[head]], axis=1).astype(np.int64)


def _kept_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Words that no run holds after its first period."""
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover)[:n] == 0


def _texts(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    before = np.append(0, np.cumsum(kept))
    n_kept = before[words.first[1:]] - before[words.first[:-1]]
    data = np.repeat(kept, words.end - words.start + 1)
    # The last kept word of a text has no space after it.
    last = np.flatnonzero(kept)[before[words.first[1:]][n_kept > 0] - 1]
    data[words.end[last]] = False
    size = np.append(0, np.cumsum(np.where(kept, words.end - words.start + 1, 0)))
    ends = np.append(0, np.cumsum(size[words.first[1:]] - size[words.first[:-1]] - (n_kept > 0)))
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(words.text[data])).cast(pa.string())


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """doc_id, n_words, runs, collapsed.

    ``runs`` is an array of (start, length, period) in words, by start and period, of all
    runs of at least ``min_length`` words and ``min_repeats`` periods; ``collapsed`` is the
    text without the words that a run repeats after its first period.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = split_words(batch.column("text"))
            first = words.first.astype(np.int64)
            runs = runs_of(word_numbers(words)[0], first, min_length, min_repeats)
            text = np.searchsorted(first, runs[:, 0], side="right") - 1
            parts = [pa.array(c, pa.int64()) for c in (runs[:, 0] - first[text], runs[:, 1], runs[:, 2])]
            offsets = np.searchsorted(text, np.arange(len(first))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["start", "length", "period"])),
                    _texts(words, _kept_words(runs, len(words.start))),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals, null if there is none."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, none, better)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document by its digest repeats one stretch to its end, as the contract of the query says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    marked = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(marked, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    cut = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)) + 1).cast("int"))
    left = F.col("n") - F.col("a")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), left)), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_periodic_tails(read(spark, sf_dir, "documents"))).withColumn("best", most_repeated(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    exponent = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), exponent.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
