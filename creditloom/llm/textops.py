"""Vectorised word handling for tasks that walk whole texts.

A chunk of texts is one byte buffer; words are maximal runs of bytes that are
not ASCII white space (0x20, 0x09-0x0D). Nothing here depends on Spark: each
function turns arrays of one bounded chunk into arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of ASCII letters, digits and all non-ASCII characters: words without punctuation.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a chunk: ``text[start:end]`` each; words of text i are ``first[i]:first[i + 1]``."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        up, down = _power_tables(len(self.text) + 1)
        running = np.zeros(len(self.text) + 1, dtype=np.uint64)
        np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[: len(self.text)], out=running[1:], dtype=np.uint64)
        return mix((running[self.end] - running[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each hold about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, lower: bool = False, inner: np.ndarray | None = None) -> Words:
    """Words of each text; the kept buffer has exactly one space between words.

    ``inner`` marks the bytes that make up words (default: all but white space).
    """
    raw, offsets = text_bytes(column)
    if lower:
        raw = LOWER[raw]
    inside = (~_SPACE if inner is None else inner)[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    starts = inside & ~before
    starts[heads] = inside[heads]
    # A word ends where the next byte is a separator or another text.
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    ends[tails] = inside[tails]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(s, offsets)
    lengths = e - s
    # Word k moves to the place where all words before it, each with one space, end.
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    packed = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
    if len(s):
        place = np.ones(len(packed), dtype=bool)
        place[end] = False
        packed[place] = raw[inside]
    return Words(packed, start, end, first)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes (runs over text borders included)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = words[n - 1 :].copy()
    weight = np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(1, n):
            weight = weight * _GRAM
            total += words[n - 1 - back : len(words) - back] * weight
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return np.empty(0, values.dtype)
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def within_text(first: np.ndarray, n: int) -> np.ndarray:
    """Start words of all runs of n words that stay inside their text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    base = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total)


def distinct_spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each span ``raw[cuts[k]:cuts[k + 1]]`` among the distinct spans, and these (binary), by first place."""
    if len(cuts) < 2:
        return np.empty(0, np.int32), pa.array([], pa.large_binary())
    offsets = np.ascontiguousarray(cuts, dtype=np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def word_numbers(words: Words) -> tuple[np.ndarray, pa.Array]:
    """Number of each word among the distinct words; these carry the space that follows them."""
    return distinct_spans(words.text, np.append(words.start, len(words.text)))


def gather(values: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Items ``which`` of a ragged table in a row; ``values`` holds the items one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    took = lengths[which]
    ends = np.cumsum(took)
    starts = (np.cumsum(lengths) - lengths)[which]
    return values[np.repeat(starts - (ends - took), took) + np.arange(int(ends[-1]) if len(ends) else 0)]
