"""Bootstrap intervals of AUC, Gini and KS from score cells.

Rows collapse to one cell per distinct score. Drawing rows with replacement is a multinomial draw
over the cells, made from the top of a tree: class totals, then the totals of slices, then of
parts of slices, then of cells. A node passes its totals on whole, so the totals of every draw
are exact, and each leaf knows from above what lies below it in score: one pass completes AUC and KS.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.operators.ranking import even_slices, score_cells

#: Score cells of one task; more cells make more tasks of this size.
CELLS_PER_TASK = 4096

_PLACE = ("p", "n", "pb", "nb", "tp", "tn")  # totals of a node, what lies below it, and class totals of each draw
_PLACE_TYPE = ", ".join(f"{c} array<long>" for c in _PLACE)


def _rng(pdf: pd.DataFrame, seed: int, by: Sequence[str], *node: str) -> np.random.Generator:
    """Numbers that depend on group, chunk and node only, so a lost task draws the same again."""
    group = zlib.crc32(repr([str(pdf[c].iloc[0]) for c in by]).encode())
    return np.random.default_rng([seed, group, int(pdf["chunk"].iloc[0]), len(node), *(int(pdf[c].iloc[0]) for c in node)])


def _split(rng: np.random.Generator, totals: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Totals of each draw dealt to parts in proportion to their counts (draw x part)."""
    whole = counts.sum()
    if not whole:
        return np.zeros((len(totals), len(counts)), dtype=np.int64)
    return rng.multinomial(totals, counts / whole)


def _class_totals(rng: np.random.Generator, pos: int, neg: int, draws: int, stratified: bool) -> tuple[np.ndarray, np.ndarray]:
    tp = np.full(draws, pos) if stratified else rng.binomial(pos + neg, pos / (pos + neg), draws)
    return tp, pos + neg - tp


def _children(rng: np.random.Generator, place: dict[str, np.ndarray], pos: np.ndarray, neg: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The place of each part of a node, in score order."""
    p, n = _split(rng, place["p"], pos), _split(rng, place["n"], neg)
    pb, nb = place["pb"][:, None] + np.cumsum(p, 1) - p, place["nb"][:, None] + np.cumsum(n, 1) - n
    return [{"p": p[:, k], "n": n[:, k], "pb": pb[:, k], "nb": nb[:, k], "tp": place["tp"], "tn": place["tn"]} for k in range(len(pos))]


def _root(rng: np.random.Generator, pos: int, neg: int, draws: int, stratified: bool) -> dict[str, np.ndarray]:
    tp, tn = _class_totals(rng, pos, neg, draws, stratified)
    none = np.zeros(draws, dtype=np.int64)
    return {"p": tp, "n": tn, "pb": none, "nb": none, "tp": tp, "tn": tn}


def _finish(rng: np.random.Generator, place: dict[str, np.ndarray], pos: np.ndarray, neg: np.ndarray) -> dict[str, np.ndarray]:
    """Draws of the cells of one leaf, and their share of AUC and KS."""
    p, n = _split(rng, place["p"], pos), _split(rng, place["n"], neg)
    tp, tn = place["tp"][:, None], place["tn"][:, None]
    n_below, p_below = place["nb"][:, None] + np.cumsum(n, 1) - n, place["pb"][:, None] + np.cumsum(p, 1) - p
    gap = n_below / np.maximum(tn, 1) - p_below / np.maximum(tp, 1)
    return {"p": p, "n": n, "won": (p * (n_below + n / 2)).sum(1), "gap": gap.max(1)}


def cell_draws(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",),
    iterations: int = 1000, seed: int = S.SEED, stratified: bool = False, chunk: int = 125, per_task: int = CELLS_PER_TASK,
) -> DataFrame:
    """(keys, draw, won, gap, tp, tn, pos, neg): one row per draw and leaf.

    ``pos`` and ``neg`` are the drawn rows of the leaf's cells by class (arrays in score order), ``tp`` and ``tn`` the
    class totals of the draw, ``won`` and ``gap`` what the leaf adds to AUC and KS.
    """
    by, parts = list(by), -(-iterations // chunk)
    cells = even_slices(score_cells(df, label, score, by), "score", by, per_task).withColumnRenamed("score", "at")
    sliced = "s1" in cells.columns
    types = dict(cells.dtypes)
    keys = "".join(f"`{c}` {types[c]}, " for c in by)
    chunks = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("chunk")

    def numbers(pdf: pd.DataFrame) -> np.ndarray:
        part = int(pdf["chunk"].iloc[0])
        return part * chunk + np.arange(min(chunk, iterations - part * chunk))

    def report(pdf: pd.DataFrame, place: dict[str, np.ndarray], *node: str) -> pd.DataFrame:
        done = _finish(_rng(pdf, seed, by, *node), place, pdf["pos"].to_numpy(), pdf["neg"].to_numpy())
        frame = pd.DataFrame({"draw": numbers(pdf), "won": done["won"], "gap": done["gap"], "tp": place["tp"], "tn": place["tn"]})
        frame["pos"], frame["neg"] = list(done["p"]), list(done["n"])
        return frame.assign(**{c: pdf[c].iloc[0] for c in by})[[*by, "draw", "won", "gap", "tp", "tn", "pos", "neg"]]

    out = keys + "draw long, won double, gap double, tp long, tn long, pos array<long>, neg array<long>"
    if not sliced:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("at")
            place = _root(_rng(pdf, seed, by), int(pdf["pos"].sum()), int(pdf["neg"].sum()), len(numbers(pdf)), stratified)
            return report(pdf, place, "chunk")

        return cells.select("*", chunks).groupBy(*by, "chunk").applyInPandas(whole, out)

    def placed(pdf: pd.DataFrame, nodes: list[dict[str, np.ndarray]], name: str) -> pd.DataFrame:
        frame = pd.DataFrame({c: [node[c] for node in nodes] for c in _PLACE})
        same = [c for c in (*by, "s1", "chunk") if c != name]
        frame[name] = pdf[name].to_numpy()
        return frame.assign(**{c: pdf[c].iloc[0] for c in same if c in pdf})

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s1")
        rng, pos, neg = _rng(pdf, seed, by), pdf["pos"].to_numpy(), pdf["neg"].to_numpy()
        root = _root(rng, int(pos.sum()), int(neg.sum()), len(numbers(pdf)), stratified)
        return placed(pdf, _children(rng, root, pos, neg), "s1")[[*by, "s1", "chunk", *_PLACE]]

    def middle(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or above.empty:
            return pd.DataFrame(columns=[*by, "s1", "s2", "chunk", *_PLACE])
        pdf = pdf.sort_values("s2")
        nodes = _children(_rng(pdf, seed, by, "s1"), {c: above[c].iloc[0] for c in _PLACE}, pdf["pos"].to_numpy(), pdf["neg"].to_numpy())
        return placed(pdf, nodes, "s2")[[*by, "s1", "s2", "chunk", *_PLACE]]

    def leaf(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or above.empty:
            return pd.DataFrame(columns=[*by, "draw", "won", "gap", "tp", "tn", "pos", "neg"])
        return report(pdf.sort_values("at"), {c: above[c].iloc[0] for c in _PLACE}, "s1", "s2")

    sums = [F.sum("pos").alias("pos"), F.sum("neg").alias("neg")]
    low = cells.groupBy(*by, "s1", "s2").agg(*sums)
    high = low.groupBy(*by, "s1").agg(*sums)
    first = high.select("*", chunks).groupBy(*by, "chunk").applyInPandas(top, f"{keys}s1 int, chunk int, {_PLACE_TYPE}")
    second = (
        low.select("*", chunks).groupBy(*by, "s1", "chunk").cogroup(first.groupBy(*by, "s1", "chunk"))
        .applyInPandas(middle, f"{keys}s1 int, s2 int, chunk int, {_PLACE_TYPE}")
    )
    node = [*by, "s1", "s2", "chunk"]
    return cells.select("*", chunks).groupBy(*node).cogroup(second.groupBy(*node)).applyInPandas(leaf, out)


def bootstrap_draws(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",),
    iterations: int = 1000, seed: int = S.SEED, stratified: bool = False, chunk: int = 125, per_task: int = CELLS_PER_TASK,
) -> DataFrame:
    """(keys, draw, auc, ks): one row per usable draw.

    A draw takes as many rows as there are; ``stratified`` takes as many of each class as there are. A
    task has one group, one chunk of draws and ``per_task`` score cells. Draws with one class are skipped.
    """
    done = cell_draws(df, label, score, by, iterations, seed, stratified, chunk, per_task)
    return (
        done.where((F.col("tp") > 0) & (F.col("tn") > 0)).groupBy(*by, "draw")
        .agg((F.sum("won") / (F.max("tp") * F.max("tn"))).alias("auc"), F.greatest(F.max("gap"), F.lit(0.0)).alias("ks"))
    )


def bootstrap_ci(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ("model",),
    iterations: int = 1000, confidence: float = 0.95, seed: int = S.SEED, stratified: bool = False,
) -> DataFrame:
    """Percentile intervals per group; KS is included for stratified draws."""
    lo = (1.0 - confidence) / 2.0
    draws = bootstrap_draws(df, label, score, by, iterations, seed, stratified)
    q = lambda c, p: F.percentile(c, F.lit(p))
    gini = F.col("auc") * 2.0 - 1.0
    aggs = [
        q(F.col("auc"), lo).alias("auc_ci_lower"), q(F.col("auc"), 1.0 - lo).alias("auc_ci_upper"),
        q(gini, lo).alias("gini_ci_lower"), q(gini, 1.0 - lo).alias("gini_ci_upper"),
    ]
    if stratified:
        aggs += [q(F.col("ks"), lo).alias("ks_ci_lower"), q(F.col("ks"), 1.0 - lo).alias("ks_ci_upper")]
    return draws.groupBy(*by).agg(*aggs)
