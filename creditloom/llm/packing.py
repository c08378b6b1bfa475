"""Sum-of-squares online packing of tokenised documents.

Each task packs the documents of its own partition, one at a time, without a
shuffle. A level array counts the open sequences by fill. A document goes to
the level (or a new sequence) that makes the sum of squared counts smallest, so
no fill level piles up and gaps get closed. Documents beyond the capacity
first fill whole sequences of their own; only their rest is placed.

When a task ends, the sequences still open are poured together: pieces of the
emptiest are cut to fill the fullest, and the last one is cut into
powers of two, which need no padding. So padding is zero, and at
most one document per closed gap is cut.

Rows: null text counts as empty and is the end token alone; null ids stay;
repeated rows are packed each; empty tables give empty results; a text of any
length is packed whole; further columns are ignored. Only open sequences (fewer
than one a level in practice) are held in memory. A lost task repeats its
partition and gives the same sequences, whose ids carry the partition number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from creditloom.llm.common import query, read
from creditloom.llm.textops import chunks, gather, split_words, word_numbers

CAPACITY = 4096
END_ID = 2
#: Distinct parts of words whose ids a worker remembers; beyond it only those of the present chunk stay.
CACHE_PARTS = 400_000
#: Bytes of text worked on at once: more of its words are repeated ones.
CHUNK = 4 << 20

_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r".,;:!?|)(%*&#$\"/+=~_-"
#: A plain word: letters whose lower case and normal form are simple, then ASCII punctuation that forms one token run.
_PLAIN = f"^(?P<core>[{_LETTERS}]+)(?P<tail>[{_SIGNS}]*)$"
_RUN = f"^(?:[{_LETTERS}]+|[{_SIGNS}]+)$"


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer's pieces never reach across white space, so a text's ids are
    those of its words in a row. Words are cut at ASCII white space (other white space inside
    a word is the library's matter), and plain words into letters and closing signs. The library encodes
    each distinct part once; texts are laid out by ragged gathers of the ids of their parts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.known = pa.array([], pa.large_string())
        self.values, self.lengths = np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)

    def _each(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        found = [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return found, list(map(len, found))

    def _runs(self, parts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of parts that are one run of letters or of signs each: the library gets many in one string.

        Each such part is one piece for the tokenizer, and exactly its last token is a word end.
        """
        groups = [parts[k : k + 256] for k in range(0, len(parts), 256)]
        out: list[np.ndarray] = []
        lengths: list[int] = []
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group):
                out.append(ids)
                lengths += np.diff(cut, prepend=0).tolist()
            else:
                each, sizes = self._each(group)
                out += each
                lengths += sizes
        return out, lengths

    def _add(self, parts: pa.Array) -> None:
        """Encode new parts and remember them."""
        run = pc.match_substring_regex(parts, _RUN)
        for chosen, how in ((parts.filter(run), self._runs), (parts.filter(pc.invert(run)), self._each)):
            ids, lengths = how(chosen.to_pylist())
            self.known = pa.concat_arrays([self.known, chosen])
            self.values = np.concatenate([self.values, *ids])
            self.lengths = np.append(self.lengths, np.array(lengths, dtype=np.int64))

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """Places of distinct parts in the table of known ones."""
        at = pc.index_in(parts, value_set=self.known)
        if at.null_count:
            if len(self.known) + at.null_count > CACHE_PARTS:
                kept = at.drop_null().to_numpy().astype(np.int64)
                self.values = gather(self.values, self.lengths, kept)
                self.lengths, self.known = self.lengths[kept], self.known.take(pa.array(kept))
            self._add(parts.filter(at.is_null()))
            at = pc.index_in(parts, value_set=self.known)
        return at.to_numpy().astype(np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (little-endian unsigned 32-bit), and the offsets of each text's ids."""
        split = split_words(column)
        which, distinct = word_numbers(split)
        # Without the space that follows each word.
        words = pc.utf8_slice_codeunits(distinct.cast(pa.large_string()), 0, -1)
        plain = pc.extract_regex(words, _PLAIN)
        core = pc.if_else(plain.is_valid(), pc.utf8_lower(pc.struct_field(plain, "core")), words)
        tail = pc.if_else(plain.is_valid(), pc.struct_field(plain, "tail"), "")
        parts = pa.chunked_array([core, tail]).combine_chunks().dictionary_encode()
        n = len(words)
        pair = self._numbers(parts.dictionary)[parts.indices.to_numpy()].reshape(2, n).T.ravel() if n else np.empty(0, np.int64)
        sizes = self.lengths[pair].reshape(n, 2).sum(axis=1)
        ends = np.append(0, np.cumsum(sizes[which]))
        return gather(gather(self.values, self.lengths, pair), sizes, which), ends[split.first]


class LevelPacker:
    """Sum-of-squares placement; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)

    def choose(self, size: int) -> int:
        """Fill level to place ``size`` tokens on; 0 is a new sequence.

        Moving one sequence from h to h + size changes the sum of squares by
        2 (N[h + size] - N[h] + 1); a new or a filled one by its one-sided part.
        Ties go to the fullest.
        """
        at = np.flatnonzero(self.level[1 : self.capacity - size + 1]) + 1
        if not len(at):
            return 0
        to = at + size
        change = 1 - 2 * self.level[at] + np.where(to < self.capacity, 2 * self.level[to] + 1, 0)
        best = int(change.min())
        if 2 * int(self.level[size]) + 1 < best:
            return 0
        return int(at[np.flatnonzero(change == best)[-1]])

    def place(self, piece: tuple, size: int) -> list[tuple] | None:
        """Place one piece of fewer tokens than the capacity; returns the sequence it fills, if it does."""
        h = self.choose(size)
        if h:
            sequence = self.open[h].pop()
            self.level[h] -= 1
        else:
            sequence = []
        sequence.append(piece)
        if h + size == self.capacity:
            return sequence
        self.level[h + size] += 1
        self.open[h + size].append(sequence)
        return None

    def finish(self) -> Iterator[list[tuple]]:
        """Pour the open sequences together: all full but the last, which is cut into powers of two."""
        # Fullest first, so that the emptiest are the ones whose pieces are cut into gaps.
        pieces = [p for h in sorted(self.open, reverse=True) for s in self.open[h] for p in s]
        self.level[:] = 0
        self.open.clear()
        total = sum(len(p[2]) // 4 for p in pieces)
        targets = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        targets += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        at = 0
        carry: tuple | None = None
        for target in targets:
            sequence, room = [], target
            while room:
                if carry is None:
                    carry = pieces[at]
                    at += 1
                doc, start, ids, n = carry
                size = len(ids) // 4
                if size <= room:
                    sequence.append(carry)
                    room -= size
                    carry = None
                else:
                    sequence.append((doc, start, ids[: 4 * room], n))
                    carry = (doc, start + room, ids[4 * room :], n)
                    room = 0
            yield sequence


_coders: dict[str, WordIds] = {}


def _coder(path: str) -> WordIds:
    if path not in _coders:
        _coders[path] = WordIds(path)
    return _coders[path]


def _rows(sequences: Iterable[list[tuple]], ids: Iterator[int]) -> pa.RecordBatch:
    out: list[tuple] = []
    for sequence in sequences:
        number, offset = next(ids), 0
        for doc, start, data, n in sequence:
            size = len(data) // 4
            out.append((doc, start, size, data, n, number, offset))
            offset += size
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: one row a piece.

    ``ids`` are little-endian unsigned 32-bit token ids; ``tokenizer`` is a path that
    every worker can read. Each token of each document lies in exactly one piece.
    """
    name = "word_bpe_49k.json"
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = _coder(tokenizer or public_tokenizers.path(name)), LevelPacker(capacity)
        numbers = iter(range((TaskContext.get().partitionId()) << 40, 1 << 62))
        for batch in chunks(batches, limit=CHUNK):
            full = []
            ids, offsets = coder.encode(batch.column("text"))
            flat = ids.tobytes()
            for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), (4 * offsets[:-1]).tolist(), (4 * offsets[1:]).tolist(), strict=True):
                data = flat[lo:hi] + end
                n = len(data) // 4
                whole = n - n % capacity
                full += [[(doc, k, data[4 * k : 4 * (k + capacity)], n)] for k in range(0, whole, capacity)]
                if n > whole and (done := packer.place((doc, whole, data[4 * whole :], n), n - whole)):
                    full.append(done)
            if full:
                yield _rows(full, numbers)
        if last := list(packer.finish()):
            yield _rows(last, numbers)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack_documents(read(spark, sf_dir, "documents")))
