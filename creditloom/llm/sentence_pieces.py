"""Exact SentencePiece encoding by backtracking, and decoding.

A sequence of pieces is the encoding of its text exactly if every two adjacent pieces
stay apart when their joined string is merged anew (and each piece alone is merged to
itself). So a segment is encoded from left to right without merging it:

* one Aho-Corasick pass finds all pieces that start at each character;
* the longest piece that is compatible with the one before is taken, then shorter ones;
* where none fits, the last piece is given back and its place is marked in a bitfield: at most
  one piece sequence ends at a place, so a place that failed fails for good.

Compatibility of two pieces is found by merging their string (best score first,
leftmost of equals) and remembered.

Texts are cut into segments before each run of marks (where no piece reaches across),
segments into parts at adjacent characters that no piece holds side by side. The
distinct segments of a chunk are solved once and laid out by one ragged gather. Memories are
bounded (``CACHE_PARTS``, ``CACHE_PAIRS``) and keep what was asked for last; that changes no result.

Rows: null text counts as empty (only the end id); null ids stay; repeated rows are encoded each; empty
tables give empty results; a text is encoded whole at any length; further columns are
ignored. Special strings inside texts are ordinary text; characters outside the
vocabulary become UTF-8 bytes. No shuffle.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import query, read
from creditloom.llm.textops import chunks, distinct_spans, gather, text_bytes

MODEL = "piece_bpe_32k.model"
#: Parts and pairs of pieces that a worker remembers before it forgets the older ones.
CACHE_PARTS = 300_000
CACHE_PAIRS = 600_000
#: Bytes of text worked on at once: more of its words are repeated ones.
CHUNK = 4 << 20

_MARK = "▁"
_SPACE = 0x20
_CLOSING = ".,;:!?|)]}\"'*#$%&\n"


class Memory:
    """A dictionary of two generations: ``age`` makes the new one old once it has grown to the limit."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def age(self) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}


class PieceCodec:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end_id = model.eos_id()
        self.score: dict[str, float] = {}
        self.pieces: dict[str, int] = {}
        self.byte_ids = [0] * 256
        spelt, plain = [b""] * size, np.zeros(size, dtype=bool)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                spelt[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece], self.score[piece] = i, model.get_score(i)
                spelt[i], plain[i] = piece.replace(_MARK, " ").encode(), True
        self._spelt = np.frombuffer(b"".join(spelt), dtype=np.uint8)
        self._spelt_size = np.array([len(b) for b in spelt], dtype=np.int64)
        self._plain = plain
        self._marked = np.array([b[:1] == b" " for b in spelt]) & plain
        # Ids whose text the library makes by rules of its own (the unknown piece).
        self._odd = np.array([model.is_unknown(i) or model.is_unused(i) for i in range(size)])
        self.alphabet = {c for piece in self.pieces for c in piece}
        self.joined = {piece[k : k + 2] for piece in self.pieces for k in range(len(piece) - 1)}
        #: Whether a text can be cut before each run of marks.
        self.cuts_words = not any(pair[1] == _MARK != pair[0] for pair in self.joined)
        # Numbers 1, 2, ... stand for pieces; 0 for the beginning of a part. A character that only occurs inside longer pieces is a piece
        # without an id while merging, and is spelt in bytes afterwards.
        self._names = ["", *self.pieces, *sorted(self.alphabet - self.pieces.keys())]
        self._sizes = [len(name) for name in self._names]
        # Lengths of all pieces, and for each the longest piece that it begins with.
        self._shorter = [0] * len(self._names)
        self._spelled = [np.array([self.pieces[name]] if name in self.pieces else self._bytes(name), dtype="<i4").tobytes() for name in self._names]
        self._starts = ahocorasick.Automaton()
        for number, name in enumerate(self._names[1:], start=1):
            self._starts.add_word(name, (number, len(name) - 1))
        self._starts.make_automaton()
        numbers = {name: number for number, name in enumerate(self._names)}
        for number, name in enumerate(self._names[1:], start=1):
            self._shorter[number] = next((numbers[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in numbers), 0)
        self._apart, self._parts = Memory(CACHE_PAIRS), Memory(CACHE_PARTS)

    def _bytes(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode()]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging: the best-scored neighbours first, leftmost of equals."""
        parts, score = list(text), self.score.get
        none = -math.inf
        scores = [score(a + b, none) for a, b in itertools.pairwise(parts)]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def _stays(self, left: int, right: int) -> bool:
        """Whether merging two pieces in a row gives just these; 0: nothing stands before."""
        key, memory = left << 32 | right, self._apart
        known = memory.old.get(key)
        if known is None:
            pair = [self._names[i] for i in (left, right) if i]
            known = self.merged("".join(pair)) == pair
        memory.new[key] = known
        return known

    def _backtrack(self, part: str) -> list[int]:
        """Piece numbers of a part whose characters all occur in pieces."""
        n, sizes, shorter, apart = len(part), self._sizes, self._shorter, self._apart.new.get
        longest = [0] * n
        for end, (number, back) in self._starts.iter(part):
            longest[end - back] = number  # ends rise, so the longest comes last
        failed = bytearray(n // 8 + 1)
        taken: list[int] = []
        at, left, piece = 0, 0, longest[0]
        while True:
            while piece:
                end = at + sizes[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = apart(left << 32 | piece)
                    if fits or fits is None and self._stays(left, piece):
                        break
                piece = shorter[piece]
            if piece:
                taken.append(piece)
                at, left = end, piece
                if at == n:
                    return taken
                piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not taken:
                    raise ValueError("this model does not encode by merging alone")
                piece = taken.pop()
                at -= sizes[piece]
                piece = shorter[piece]
                left = taken[-1] if taken else 0

    def _part(self, part: str) -> bytes:
        known = self._parts.old.get(part)
        if known is None:
            spelled = self._spelled
            known = b"".join([spelled[number] for number in self._backtrack(part)])
        if len(part) <= 64:
            self._parts.new[part] = known
        return known

    def _cut(self, segment: str) -> Iterator[str]:
        """Parts between characters that no piece holds side by side."""
        at, joined = 0, self.joined
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in joined:
                yield segment[at:k]
                at = k
        yield segment[at:]

    def _segment(self, segment: str) -> bytes:
        """Ids (four bytes each) of a string in which marks stand for blanks."""
        found = []
        for part in self._cut(segment):
            if part[0] in self.alphabet:
                found.append(self._parts.new.get(part) or self._part(part))
            else:
                found.append(np.array(self._bytes(part), dtype="<i4").tobytes())
        return b"".join(found)

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment. The usual one is a word that all pieces know, with closing signs that no piece joins to it."""
        self._parts.age()
        self._apart.age()
        parts, alphabet, joined, out = self._parts.new.get, self.alphabet, self.joined, []
        for segment in segments:
            known = parts(segment)
            if known is None:
                core = segment.rstrip(_CLOSING)
                n = len(core)
                if n and len(segment) <= 64 and alphabet.issuperset(segment) and segment[n - 1 : n + 1] not in joined:
                    known = parts(core) or self._part(core)
                    if n < len(segment):
                        tail = segment[n:]
                        known += parts(tail) or self._part(tail)
                else:
                    known = self._segment(segment)
            out.append(known)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's ids, without begin and end ids."""
        column = pc.replace_substring(pc.fill_null(column, ""), _MARK, " ")
        # The library sets one mark before every text but the empty one.
        column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(" ", column, ""))
        raw, offsets = text_bytes(column)
        heads = np.zeros(len(raw) + 1, dtype=bool)
        heads[offsets] = True
        if self.cuts_words and len(raw):
            space = raw == _SPACE
            heads[1:-1] |= space[1:] & ~space[:-1]
        cuts = np.flatnonzero(heads)
        which, segments = distinct_spans(raw, cuts)
        segments = pc.replace_substring(segments.cast(pa.large_string()), " ", _MARK).to_pylist()
        solved = self._segments(segments)
        lengths = np.fromiter(map(len, solved), dtype=np.int64, count=len(solved)) // 4
        table = np.frombuffer(b"".join(solved), dtype="<i4")
        ends = np.append(0, np.cumsum(lengths[which]))
        return gather(table, lengths, which), ends[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Text of each stretch of ids; control ids say nothing, and one blank before the text goes."""
        n = len(offsets) - 1
        data = gather(self._spelt, self._spelt_size, ids)
        before = np.append(0, np.cumsum(self._spelt_size[ids]))
        starts, ends = before[offsets[:-1]].copy(), before[offsets[1:]]
        said = np.flatnonzero(self._spelt_size[ids])
        at = np.searchsorted(said, offsets[:-1])
        opening = np.full(n, -1, dtype=np.int64)
        some = ends > starts
        opening[some] = ids[said[at[some]]]
        odd = np.zeros(n, dtype=bool)
        odd[np.searchsorted(offsets, np.flatnonzero(self._odd[ids]), side="right") - 1] = True
        odd |= some & ~self._plain[opening]
        starts += some & self._marked[opening]
        out = [None] * n
        raw = data.tobytes()
        for k, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            if not odd[k]:
                try:
                    out[k] = raw[lo:hi].decode()
                    continue
                except UnicodeDecodeError:
                    pass
            # Bytes that are no UTF-8, or ids that have no text of their own: the library's own signs for them.
            out[k] = self.model.decode(ids[offsets[k] : offsets[k + 1]].tolist())
        return pa.array(out, pa.string())


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec a worker; its memories live as long as the worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.insert(ids, offsets[1:], end_id)
    return out, offsets + np.arange(len(offsets))


def encode_documents(docs: DataFrame, model: str | None = None, end: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, ids and, with ``decoded``, the text that the ids stand for.

    ``model`` is a path that every worker can read; a missing file fails in the task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model or public_tokenizers.path(MODEL))
        for batch in chunks(batches, limit=CHUNK):
            ids, offsets = coder.encode(batch.column("text"))
            if end:
                ids, offsets = _with_end(ids, offsets, coder.end_id)
            out = {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))}
            if decoded:
                out["decoded"] = coder.decode(ids, offsets)
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text: what the ids of each row stand for; null ids count as none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model or public_tokenizers.path(MODEL))
        for batch in batches:
            lists = batch.column("ids")
            offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
            text = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": text})

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(work, "doc_id long, text string")


@query("op12_sentence_pieces")
def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(read(spark, sf_dir, "documents"), decoded=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
