"""Quality by ordinal cumulative-link regression.

Grades are ordered; one score s = w.x per text is shared by all of them and
P(grade <= k) = sigmoid(theta_k - s) with increasing thresholds theta. From these come the
expected grade and the probability of the upper tail.

x holds hashed words (each distinct word with the fourth root of 1 / number of distinct
words, so that length matters little) and a few measures of form. Words of fewer than
``MIN_TEXTS`` training texts are left out, and rare grades weigh more (root of the
inverse share). Training is full-batch L-BFGS on at most about
``TRAIN_ROWS`` labelled texts (chosen by a digest of the id; the bound is a parameter):
every step sums gradients in the tasks and sends one vector of the kept words (at most ``SLOTS``) a partition to the
driver. Scoring is one pass over all texts without a shuffle.

Rows: null text counts as empty and gets a score from its measures alone;
null ids stay and are never labelled; labels with a null part teach nothing;
several labels of one id count by their lowest grade; repeated rows are repeated; without any
label all texts get grade 0 and tail 0; with labels of one grade all get that grade;
empty tables give empty results; further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import query, read, stage
from creditloom.llm.textops import ALNUM, chunks, split_words, text_bytes

SLOTS = 1 << 20
TRAIN_ROWS = 20_000
MIN_TEXTS = 5
RIDGE = 1e-4
STEPS = 60
FORM = 8

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 4


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a chunk of texts: row bounds, slots and values (hashed words, then FORM measures)."""
    raw, offsets = text_bytes(column)
    kinds = _CLASS[raw]
    spaces, upper, digits, signs = (_per_text(kinds == k, offsets) for k in (1, 2, 3, 4))
    ink = np.maximum(np.diff(offsets) - spaces, 1)
    words = split_words(pc.utf8_lower(pc.fill_null(column, "")), inner=ALNUM)
    n, hashes = len(words.first) - 1, words.hashes()
    counts = np.diff(words.first)
    text = np.repeat(np.arange(n), counts)
    pairs = np.unique(text.astype(np.uint64) * np.uint64(SLOTS) + (hashes >> np.uint64(40)) % np.uint64(SLOTS))
    row, slot = (pairs // np.uint64(SLOTS)).astype(np.int64), (pairs % np.uint64(SLOTS)).astype(np.int64)
    distinct = np.bincount(row, minlength=n)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    some = np.maximum(counts, 1)
    form = np.column_stack([
        np.ones(n), np.log1p(counts) / 10, distinct / some, _per_text(same, words.first) / some,
        _per_text(words.end - words.start, words.first) / some / 10, upper / ink, digits / ink, signs / ink,
    ])
    bounds = np.concatenate([[0], np.cumsum(distinct + FORM)])
    slots, values = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.float32)
    is_form = np.zeros(bounds[-1], bool)
    is_form[(bounds[1:, None] - FORM + np.arange(FORM)).ravel()] = True
    slots[~is_form], values[~is_form] = slot, (np.maximum(distinct, 1.0) ** -0.25)[row]
    slots[is_form], values[is_form] = np.tile(SLOTS + np.arange(FORM), n), form.ravel()
    return bounds, slots, values


def _dots(weights: np.ndarray, bounds: np.ndarray, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
    return _per_text(weights[slots] * values, bounds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Weights of slots and measures, and increasing thresholds; grade k lies between thresholds k-1 and k."""

    weights: np.ndarray
    thresholds: np.ndarray

    def cumulative(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each text and threshold."""
        return _sigmoid(self.thresholds[None, :] - score[:, None])


def _thresholds(free: np.ndarray) -> np.ndarray:
    """Increasing thresholds from free numbers: the first, then logarithms of the steps."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def loss_and_gradient(params: np.ndarray, size: int, grades: int, bounds, slots, values, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted sum over texts of the negative log likelihood, and its gradient by (weights, free thresholds)."""
    w, free = params[:size], params[size:]
    theta = _thresholds(free)
    s = _dots(w, bounds, slots, values)
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    upper, lower = _sigmoid(edge[y + 1] - s), _sigmoid(edge[y] - s)
    p = np.maximum(upper - lower, 1e-12)
    by_score = weight * (1 - upper - lower)
    grad_w = np.bincount(slots, weights=values * np.repeat(by_score, np.diff(bounds)), minlength=size)
    by_theta = np.zeros(grades + 1)
    np.add.at(by_theta, y + 1, -weight * upper * (1 - upper) / p)
    np.add.at(by_theta, y, weight * lower * (1 - lower) / p)
    by_theta = by_theta[1:-1]
    tail = np.cumsum(by_theta[::-1])[::-1]
    by_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
    return float(-(weight * np.log(p)).sum()), np.concatenate([grad_w, by_free])


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving."""
    x, (f, g) = start, evaluate(start)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, back = g.copy(), []
        for s, y in reversed(kept):
            a = (s @ q) / (s @ y)
            back.append(a)
            q -= a * y
        if kept:
            s, y = kept[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(kept, reversed(back), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        size = 1.0 if kept else min(1.0, 1 / (np.linalg.norm(g) + 1e-12))
        for _ in range(12):
            x2 = x - size * q
            f2, g2 = evaluate(x2)
            if f2 <= f - 1e-4 * size * (g @ q):
                break
            size /= 2
        else:
            break
        if (x2 - x) @ (g2 - g) > 1e-12:
            kept = [*kept[1 - memory :], (x2 - x, g2 - g)]
        done = f - f2 < 1e-5 * abs(f)
        x, f, g = x2, f2, g2
        if done:
            break
    return x


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor text, 1 well formed but toxic, 2 well formed and clean."""
    whole = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    return whole.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def fit(docs: DataFrame, graded: DataFrame, grades: int, train_rows: int = TRAIN_ROWS, steps: int = STEPS) -> OrdinalModel:
    """Learn from ``graded`` (doc_id, grade 0 to grades - 1) and the texts of ``docs``."""
    spark = docs.sparkSession
    once = graded.where(F.col("grade").between(0, grades - 1)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = once.count()
    if not n:
        return OrdinalModel(np.zeros(SLOTS + FORM), np.full(grades - 1, np.inf))
    share = min(1.0, train_rows / n)
    chosen = stage(once.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)), "graded")
    # At most about train_rows ids of 12 bytes: small enough to go to every task.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            bounds, slots, values = features(batch.column("text"))
            cut = list(zip(bounds[:-1], bounds[1:], strict=True))
            yield pa.RecordBatch.from_pydict({
                "grade": batch.column("grade"),
                "slots": pa.array([slots[a:b].tobytes() for a, b in cut], pa.binary()),
                "values": pa.array([values[a:b].tobytes() for a, b in cut], pa.binary()),
            })

    sample = stage(rows.mapInArrow(extract, "grade int, slots binary, values binary"), "training-features")
    sizes = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return OrdinalModel(np.zeros(SLOTS + FORM), np.full(grades - 1, np.inf))
    kept = _common_slots(sample)
    place = np.full(SLOTS + FORM, -1, dtype=np.int32)
    place[kept], place[SLOTS:] = np.arange(len(kept)), len(kept) + np.arange(FORM)
    size = len(kept) + FORM
    weight = np.array([sizes.get(g, 0) for g in range(grades)], dtype=np.float64)
    weight = np.sqrt(total / np.maximum(weight, 1))
    weight *= total / sum(n * weight[g] for g, n in sizes.items())
    placed = spark.sparkContext.broadcast(place)

    def evaluate(params: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(params)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad = 0.0, np.zeros(len(params))
            for batch in batches:
                if batch.num_rows:
                    parts = batch.column("slots").to_pylist()
                    slots = placed.value[np.frombuffer(b"".join(parts), np.int32)]
                    values = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.float32)
                    edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])])
                    bounds = np.concatenate([[0], np.cumsum(slots >= 0)])[edges]
                    y = batch.column("grade").to_numpy()
                    f, g = loss_and_gradient(shared.value, size, grades, bounds, slots[slots >= 0], values[slots >= 0], y, weight[y])
                    loss, grad = loss + f, grad + g
            yield pa.RecordBatch.from_pydict({"loss": [loss], "grad": [grad.tobytes()]})

        found = sample.mapInArrow(work, "loss double, grad binary").collect()
        shared.destroy()
        w = params[:size]
        grad = sum(np.frombuffer(bytes(r["grad"])) for r in found) / total
        grad = grad + np.concatenate([RIDGE * w, np.zeros(grades - 1)])
        return sum(r["loss"] for r in found) / total + RIDGE * (w @ w) / 2, grad

    best = minimise(evaluate, np.zeros(size + grades - 1), steps)
    weights = np.where(place >= 0, best[:size][np.maximum(place, 0)], 0.0)
    return OrdinalModel(weights.astype(np.float32), _thresholds(best[size:]))


def _common_slots(sample: DataFrame) -> np.ndarray:
    """Slots that at least MIN_TEXTS training texts hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + FORM, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("slots").to_pylist()), np.int32), minlength=SLOTS + FORM)
        full = np.flatnonzero(total[:SLOTS])
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], ["slot", "n"])

    found = sample.select("slots").mapInArrow(work, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TEXTS)
    return np.sort(found.select("slot").toArrow().column("slot").to_numpy())


def score(docs: DataFrame, model: OrdinalModel, tail: int) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of grade ``tail`` and above) for every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            below = shared.value.cumulative(_dots(shared.value.weights, *features(batch.column("text"))))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "expected_grade": pa.array((1 - below).sum(axis=1)),
                "tail_probability": pa.array(1 - below[:, tail - 1]),
            })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, expected_grade double, tail_probability double"
    )


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, grades_of(read(spark, sf_dir, "labels")), grades=3)
    return score(docs, model, tail=2).withColumn("keep", F.col("tail_probability") >= 0.5)
