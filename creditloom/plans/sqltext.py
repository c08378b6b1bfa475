"""Pieces of SQL shared by the oracle texts."""

from __future__ import annotations

from collections.abc import Sequence

from creditloom.functions.columns import linspace
from creditloom.sources.testbed import APPLICATIONS_SQL, SCORES_SQL

APPS = "WITH " + APPLICATIONS_SQL
SCORES = "WITH " + SCORES_SQL


def dbl(x: float) -> str:
    return f"{x!r}::DOUBLE"


def probs(n: int) -> str:
    return "[" + ", ".join(dbl(p) for p in linspace(0.0, 1.0, n)) + "]"


def long_rows(features: Sequence[str], keep: str = "default_flag AS y", source: str = "applications") -> str:
    """(feature, v, kept columns) with one SELECT per feature."""
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS v, {keep} FROM {source}" for f in features)


def binned(features: Sequence[str], n_bins: int = 10, keep: str = "default_flag AS y", kept: str = "y", source: str = "applications") -> str:
    """CTEs lng, edg, binned(feature, v, bin, ...); bin is null for missing values."""
    return f"""
, lng AS ({long_rows(features, keep, source)})
, edg AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {probs(n_bins)}))) AS e
          FROM lng WHERE v IS NOT NULL GROUP BY feature)
, binned AS (SELECT lng.feature, lng.v, {', '.join('lng.' + k.strip() for k in kept.split(','))}, e,
             CASE WHEN v IS NOT NULL THEN len(list_filter(e[2:len(e) - 1], lambda x: x < v)) END AS bin
             FROM lng JOIN edg ON lng.feature = edg.feature)
"""


def clip(c: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest({dbl(lo)}, least({dbl(hi)}, {c})) END"


def digest(*cols: str, seed: int = 42, width: int = 8) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"substr(md5(concat_ws('|', '{seed}', {parts})), 1, {width})"


SPLIT = (
    "CASE WHEN " + digest("application_id") + " < '99999999' THEN 'train' WHEN "
    + digest("application_id") + " < 'cccccccc' THEN 'val' ELSE 'test' END"
)


def fold(k: int = 5) -> str:
    """Fold number from the digest, cut at multiples of 1/k."""
    cuts = [format(int(i / k * 4294967296), "08x") for i in range(1, k)]
    h = digest("'fold'", "application_id")
    return "(" + " + ".join(f"CASE WHEN {h} >= '{c}' THEN 1 ELSE 0 END" for c in cuts) + ")"


def cells(by: str = "model", source: str = "long_scores", score: str = "score", label: str = "label", tag: str = "") -> str:
    """CTE cu<tag>: score cells with counts below and totals per group."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""
, ce{tag} AS (SELECT {keys}{score} AS score, sum({label})::BIGINT AS pos, sum(1 - {label})::BIGINT AS neg FROM {source} GROUP BY ALL)
, cu{tag} AS (SELECT *, coalesce(sum(pos) OVER w, 0)::BIGINT AS pb, coalesce(sum(neg) OVER w, 0)::BIGINT AS nb,
                   (sum(pos) OVER ({part}))::BIGINT AS P, (sum(neg) OVER ({part}))::BIGINT AS N FROM ce{tag}
            WINDOW w AS ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, rt{tag} AS (SELECT *, P - pb AS tp, N - nb AS fp, (P - pb) / nullif(P, 0)::DOUBLE AS tpr, (N - nb) / nullif(N, 0)::DOUBLE AS fpr FROM cu{tag})
"""


AUC = "sum(pos::DOUBLE * (nb + neg / 2e0)) / nullif(max(P)::DOUBLE * max(N), 0)"
KS = "greatest(0e0, max(tpr - fpr))"
BRIER = "sum(pos * (1 - score) * (1 - score) + neg * score * score) / (max(P) + max(N))"
_EPS = "2.220446049250313e-16"
LOGLOSS = (
    f"sum(-pos * ln(greatest({_EPS}, least(1 - {_EPS}, score))) - neg * ln(1 - greatest({_EPS}, least(1 - {_EPS}, score)))) / (max(P) + max(N))"
)
