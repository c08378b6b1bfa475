"""Language identification of spans by Viterbi over per-word scores.

Script ranges of a word's letters narrow the candidate languages. Each word
gets a score per candidate from smoothed letter-trigram and word counts, held within
``CLIP`` of the best so that no single word decides. A Viterbi path over the words of a text,
with a fixed penalty for every change of language, labels spans; a text's
language is the one with the most labelled letters.

Learning uses a bounded sample: ``PER_LANGUAGE`` texts a language, chosen by a digest
of their id. What is learned are counts per (language, slot) with ``SLOTS`` slots,
so the model's size does not follow the corpus. Prediction looks at text alone.

Rows: null text and text without a letter give ``und`` with score 0; so does
everything when nothing can be learned; ties go to the language first in
alphabetical order; a null id counts as empty text in the split; repeated rows
are repeated; empty tables give empty results; further columns are ignored. Texts
are read whole; memory per worker is bounded by ``CACHE_WORDS``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import query, read
from creditloom.llm.textops import chunks

UNKNOWN = "und"
PER_LANGUAGE = 4000
SLOTS = 1 << 16
SMOOTHING = 0.1
CLIP = 4.0
SWITCH = 7.0
CACHE_WORDS = 250_000
_BATCH_BYTES = 4 << 20
#: A script belongs to a language that writes at least this share of its letters in it.
SCRIPT_SHARE = 0.02

# First and last code point of the letters of each script (Unicode blocks).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
)
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def script_of(word: str) -> int:
    """Number of the script of a word's first letter."""
    code = ord(word[0])
    for name, lo, hi in SCRIPTS:
        if lo <= code <= hi:
            return SCRIPT_NAMES.index(name)
    return len(SCRIPT_NAMES) - 1


def slots_of(word: str) -> list[int]:
    """Slots of a word's letter trigrams and of the word itself."""
    marked = f"<{word}>"
    grams = [marked[k : k + 3] for k in range(len(marked) - 2)]
    grams.append("=" + word)
    return [zlib.crc32(g.encode()) % SLOTS for g in grams]


@dataclass
class Model:
    """languages in alphabetical order, log weight per (slot, language), allowed (script, language)."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words per language, best 0 and none below -CLIP."""
        slots = [slots_of(w) for w in words]
        first = np.concatenate([[0], np.cumsum([len(x) for x in slots])])[:-1]
        score = np.add.reduceat(self.weights[np.concatenate(slots)], first, axis=0)
        allowed = self.allowed[[script_of(w) for w in words]]
        # A script that no language writes leaves all of them.
        allowed |= ~allowed.any(axis=1, keepdims=True)
        score = np.where(allowed, score, -np.inf)
        return np.maximum(score - score.max(axis=1, keepdims=True), -CLIP).astype(np.float32)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from (doc_id, text, lang) rows; rows without text or lang teach nothing."""
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.try_element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))]), F.col("lang"))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in chunks(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_NOT_LETTERS.sub(" ", text).lower().split())
        for lang, counts in words.items():
            total, letters = np.zeros(SLOTS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
            for word, n in counts.items():
                np.add.at(total, slots_of(word), n)
                letters[script_of(word)] += n * len(word)
            full, seen = np.flatnonzero(total), np.flatnonzero(letters)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(full) + len(seen)), pa.string()),
                # Scripts follow the slots.
                "slot": pa.array(np.concatenate([full, SLOTS + seen]), pa.int32()),
                "n": pa.array(np.concatenate([total[full], letters[seen]]), pa.int64()),
            })

    counted = sample.mapInArrow(work, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = np.zeros((SLOTS + len(SCRIPT_NAMES), len(languages)))
    found = counted.toArrow()  # at most languages x slots rows
    column = {lang: k for k, lang in enumerate(languages)}
    at = [column[x] for x in found.column("lang").to_pylist()]
    table[found.column("slot").to_numpy(), at] = found.column("n").to_numpy()
    grams, letters = table[:SLOTS], table[SLOTS:]
    weights = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * SLOTS)).astype(np.float32)
    weights -= weights.mean(axis=1, keepdims=True)
    allowed = letters > SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    return Model(languages, weights, allowed)


class Labeller:
    """Word scores with a bounded memory, and the Viterbi labels of many texts at once."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self._empty()

    def _empty(self) -> None:
        self.rows: dict[str, int] = {}
        self.words: dict[str, int] = {"": 0}
        self.scores = np.zeros((1, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1, np.int32)

    def _learn(self, tokens: set[str]) -> None:
        """Rows of new tokens; all tokens without a letter share row 0, which favours no language."""
        # A token is cut at signs as the texts it was learned from; its score is the sum of its words'.
        bare = {t: _NOT_LETTERS.sub(" ", t).lower().strip() for t in tokens}
        new = sorted(set(bare.values()) - self.words.keys())
        if new:
            self.words.update(zip(new, range(len(self.letters), len(self.letters) + len(new)), strict=True))
            parts = [w.split() for w in new]
            first = np.concatenate([[0], np.cumsum([len(w) for w in parts])])[:-1]
            self.scores = np.concatenate([self.scores, np.add.reduceat(self.model.word_scores(list(chain.from_iterable(parts))), first, axis=0)])
            self.letters = np.concatenate([self.letters, np.array([sum(map(len, w)) for w in parts], np.int32)])
        words = self.words
        self.rows.update((t, words[w]) for t, w in bare.items())

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Row of each token of all texts in a row, and the first token of each text."""
        split = [(t or "").split() for t in texts]
        asked = set()
        for parts in split:
            asked.update(parts)
        new = asked - self.rows.keys()
        if len(self.rows) + len(new) > CACHE_WORDS:
            # A full cache starts anew with what these texts ask for.
            self._empty()
            new = asked
        self._learn(new)
        row = self.rows.__getitem__
        first = np.concatenate([[0], np.cumsum([len(p) for p in split])])
        return np.fromiter(map(row, chain.from_iterable(split)), np.int64, int(first[-1])), first

    def paths(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best language of every token: one step a position, for all texts side by side."""
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        start, size = first[:-1][order], counts[order]
        n, langs = len(rows), len(self.model.languages)
        if not n:
            return np.empty(0, np.int16)
        moved, source = np.zeros((n, langs), bool), np.zeros(n, np.int16)
        delta = np.zeros((len(size), langs), np.float32)
        live_at = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts longer than each position
        for t in range(int(size[0])):
            live = live_at[t]
            at = start[:live] + t
            d = delta[:live]
            best = d.argmax(axis=1)
            jump = d[np.arange(live), best] - np.float32(self.switch)
            moved[at] = d < jump[:, None]
            source[at] = best
            np.maximum(d, jump[:, None], out=d)
            d += self.scores[rows[at]]
        label = np.empty(n, np.int16)
        state = delta.argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = live_at[t]
            at = start[:live] + t
            now = state[:live]
            label[at] = now
            state[:live] = np.where(moved[at, now], source[at], now)
        return label


def _spans(label: np.ndarray, lo: int, hi: int, names: list[str]) -> list[dict]:
    cut = (np.flatnonzero(np.diff(label[lo:hi])) + 1).tolist() if hi > lo else []
    return [{"lang": names[label[lo + a]], "first_word": a, "last_word": b - 1} for a, b in zip([0, *cut], [*cut, hi - lo], strict=True) if b > a]


def _predictor(model: Model, switch: float):
    """Function of a list of texts: languages, scores, and the spans of each text on request."""
    names = model.languages
    labeller = Labeller(model, switch)

    def predict(texts: list[str | None]):
        if names:
            rows, first = labeller.tokens(texts)
            label, letters = labeller.paths(rows, first), labeller.letters[rows]
        else:
            first, label, letters = np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int16), np.empty(0, np.int32)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        width = max(len(names), 1)
        mass = np.bincount(text * width + label, weights=letters, minlength=len(texts) * width).reshape(len(texts), width)
        total, best = mass.sum(axis=1), mass.argmax(axis=1)
        score = np.divide(mass[np.arange(len(texts)), best], total, out=np.zeros(len(texts)), where=total > 0)
        pred = [names[b] if n > 0 else UNKNOWN for b, n in zip(best, total, strict=True)]
        return pred, score, lambda: [_spans(label, a, b, names) if n > 0 else [] for a, b, n in zip(first[:-1], first[1:], total, strict=True)]

    return predict


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, with ``spans``, the labelled spans of blank-separated words.

    ``score`` is the share of the text's letters in words labelled ``lang_pred``.
    The model is broadcast: ``SLOTS`` x languages 4-byte numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(shared.value, switch)
        for batch in chunks(batches, limit=_BATCH_BYTES):
            pred, score, found = predict(batch.column("text").to_pylist())
            out = {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)}
            if spans:
                out["spans"] = pa.array(found(), kind)
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, lang_pred string, score double"
    if spans:
        schema += ", spans array<struct<lang: string, first_word: int, last_word: int>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def keep_identified(docs: DataFrame, model: Model, min_score: float, switch: float = SWITCH) -> DataFrame:
    """Rows of ``docs`` (all columns) whose text has a language with at least ``min_score``.

    Chunks are smaller than in ``identify``: here a worker also holds the rows that it hands on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(shared.value, switch)
        for batch in chunks(batches, limit=_BATCH_BYTES // 2):
            pred, score, _ = predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([p != UNKNOWN and s >= min_score for p, s in zip(pred, score, strict=True)]))

    return docs.mapInArrow(work, docs.schema)


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model, spans=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
