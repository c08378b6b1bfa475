"""Token counts by prefix dynamic programming.

For a byte-pair encoding the encoding of a prefix depends only on its last
token: that token is the one piece ending there that stays apart from the last
token of the prefix before it. ``PrefixEncoder`` walks a segment once and so
knows the exact number of tokens of *every* prefix; truncation points and
budget questions are then look-ups in the stored counts.

Pieces never span certain pairs of adjacent characters (those that no piece of
the vocabulary holds side by side). Texts are cut there, and each distinct
segment is solved once per worker. The memory for that is bounded
(``CACHE_SEGMENTS``); a full cache starts anew, which changes no result.

Rows: null text counts as empty (0 tokens); empty tables give empty results;
repeated rows give repeated rows; further columns are ignored. A text is
processed whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import query, read
from creditloom.llm.textops import chunks

#: Distinct segments and token pairs a worker remembers.
CACHE_SEGMENTS = 600_000
MAX_TOKENS = 4096

_MARK = "▁"
_CLOSING = ".,;:!?|)]}\"'*#$%&\n"


class PrefixEncoder:
    """Exact prefix counts under a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        self.joined = {piece[k : k + 2] for piece in self.score for k in range(len(piece) - 1)}
        self.tokens = list(self.score)
        self._ends = ahocorasick.Automaton()
        for i, piece in enumerate(self.tokens, start=1):
            self._ends.add_word(piece, (i, len(piece)))
        self._ends.make_automaton()
        self._apart: dict[int, bool] = {}
        self._solved: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """Encode a short string by merging: best score first, leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of two tokens in a row is just these; 0: nothing before."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= CACHE_SEGMENTS:
                self._apart.clear()
            pair = [self.tokens[i - 1] for i in (left, right) if i]
            known = self._apart[key] = self._pieces("".join(pair)) == pair
        return known

    def _solve(self, segment: str) -> bytes:
        """Changes of the count at each character: the dynamic programme over prefixes."""
        n = len(segment)
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        last[0] = 0
        apart, at = self._apart, 0
        for end, (token, size) in self._ends.iter(segment):
            end += 1
            while at < end - 1:
                # No piece ends here: a character outside the vocabulary, spelt in UTF-8 bytes.
                at += 1
                if last[at] < 0:
                    counts[at] = counts[at - 1] + len(segment[at - 1].encode())
                    last[at] = 0
            if last[end] < 0:
                left = last[end - size]
                fits = apart.get(left << 32 | token)
                if fits is None:
                    fits = self._stay_apart(left, token)
                if fits:
                    counts[end] = counts[end - size] + 1
                    last[end] = token
                    at = end
        for at in range(at + 1, n + 1):
            counts[at] = counts[at - 1] + len(segment[at - 1].encode())
        return bytes([(counts[k + 1] - counts[k]) & 255 for k in range(n)])

    def _steps(self, segment: str) -> bytes:
        known = self._solved.get(segment)
        if known is None:
            if len(self._solved) >= CACHE_SEGMENTS:
                self._solved.clear()
            known = self._solved[segment] = self._solve(segment)
        return known

    def _word(self, word: str) -> bytes:
        """Changes of a word after one mark; closing punctuation is solved apart where no piece can span the border."""
        known = self._words.get(word)
        if known is None:
            if len(self._words) >= CACHE_SEGMENTS:
                self._words.clear()
            core = word.rstrip(_CLOSING)
            if core != word and core and word[len(core) - 1 : len(core) + 1] not in self.joined:
                known = self._steps(_MARK + core) + self._steps(word[len(core) :])
            else:
                known = self._steps(_MARK + word)
            self._words[word] = known
        return known

    def steps(self, text: str) -> bytes:
        """Change of the token count at each character of the marked text.

        The library puts one mark before the text and a mark for each blank;
        entry 0 belongs to that first mark, entry i to character i - 1.
        """
        if not text:
            return b""
        parts = text.replace(" ", _MARK).split(_MARK)
        if "" in parts:
            return b"".join(self._runs(parts))
        known = list(map(self._words.get, parts))
        if None in known:
            known = [self._word(part) if k is None else k for part, k in zip(parts, known, strict=True)]
        return b"".join(known)

    def _runs(self, parts: list[str]) -> Iterator[bytes]:
        """Words after several marks, and marks at the end of the text, are segments of their own."""
        marks = 0
        for part in parts:
            marks += 1
            if part:
                yield self._word(part) if marks == 1 else self._steps(_MARK * marks + part)
                marks = 0
        if marks:
            yield self._steps(_MARK * marks)


def prefix_counts(steps: bytes) -> np.ndarray:
    """Tokens of the prefixes of 0, 1, 2, ... characters, from stored steps."""
    if not steps:
        return np.zeros(1, np.int64)
    counts = np.cumsum(np.frombuffer(steps, dtype=np.int8), dtype=np.int64)
    counts[0] = 0
    return counts


def cut_for_budget(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    fits = np.flatnonzero(prefix_counts(steps) <= budget)
    return int(fits[-1]) if len(fits) else 0


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder a worker; its caches live as long as the worker."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def count_tokens(
    docs: DataFrame,
    model: str | None = None,
    max_tokens: int = MAX_TOKENS,
    keep_prefixes: bool = True,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_chars and the stored prefix steps.

    ``cut_chars`` is the longest prefix that keeps to ``max_tokens``. With
    ``keep_prefixes`` the column ``prefix_steps`` holds one signed byte a
    character (see ``prefix_counts``), from which any later budget is answered.
    One pass, no shuffle. A missing model file fails in the task.
    """
    name = "piece_bpe_32k.model"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model or public_tokenizers.path(name))
        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            steps = [enc.steps(t or "") for t in texts]
            total = [_total(s) for s in steps]
            cut = [
                len(t or "") if n <= max_tokens else cut_for_budget(s, max_tokens)
                for t, s, n in zip(texts, steps, total, strict=True)
            ]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(total, pa.int64()),
                "over_limit": pa.array([n > max_tokens for n in total], pa.bool_()),
                "cut_chars": pa.array(cut, pa.int64()),
            }
            if keep_prefixes:
                out["prefix_steps"] = pa.array(steps, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long"
    if keep_prefixes:
        schema += ", prefix_steps binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def _total(steps: bytes) -> int:
    return int(np.frombuffer(steps, dtype=np.int8).sum(dtype=np.int64)) if steps else 0


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), keep_prefixes=False)
