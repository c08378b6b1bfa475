"""Column expressions shared by all operators. Everything stays JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom import schema as S


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def clip(c: str | Column, lo: float | None, hi: float | None) -> Column:
    """Clip to [lo, hi]; null stays null (plain least/greatest would skip it)."""
    c = col(c)
    out = c
    if hi is not None:
        out = F.least(F.lit(hi), out)
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    return F.when(c.isNotNull(), out)


def floor_at(c: str | Column, lo: float) -> Column:
    return clip(c, lo, None)


def banded(c: str | Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first band whose upper bound exceeds the value."""
    c = col(c)
    expr = None
    for bound, label in bands:
        if bound is None:
            return F.when(c.isNotNull(), expr.otherwise(F.lit(label)))
        test = c < F.lit(bound)
        expr = F.when(test, F.lit(label)) if expr is None else expr.when(test, F.lit(label))
    return expr


def count_edges(c: str | Column, edges: Sequence[float], inclusive: bool = False) -> Column:
    """How many of the ascending ``edges`` lie below the value (int, null for null).

    ``inclusive=False`` counts edges strictly below (right-closed bins),
    ``inclusive=True`` counts edges at or below (left-closed bins). The edges form
    a balanced CASE tree: logarithmic cost per row, inside generated code.
    """
    c = col(c)
    edges = [float(e) for e in edges]

    def above(e: float) -> Column:
        return c >= F.lit(e) if inclusive else c > F.lit(e)

    if not edges:
        return F.when(c.isNotNull(), F.lit(0))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(above(edges[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(c.isNotNull(), tree(0, len(edges)))


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """n+1 evenly spaced edges, formed as start + i*step, last one exact."""
    step = (hi - lo) / n
    return [lo + i * step for i in range(n)] + [float(hi)]


def hash_hex(seed: int, *cols: str | Column, width: int = 8) -> Column:
    """Leading hex digits of md5(seed|col|...); same digest in any SQL engine."""
    parts = [F.lit(str(seed))] + [col(c).cast("string") for c in cols]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, width)


def hash_unit(seed: int, *cols: str | Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the digest."""
    return F.conv(hash_hex(seed, *cols), 16, 10).cast("double") / F.lit(4294967296.0)


def hex_threshold(p: float) -> str:
    """Eight hex digits below which a share p of digests falls."""
    return format(min(int(p * 4294967296), 0xFFFFFFFF), "08x")


def credit_score(pd: str | Column) -> Column:
    """Points-to-double-odds scaling to a whole score in 300..850."""
    p = clip(pd, 1e-6, 1.0 - 1e-6)
    import math

    factor = S.POINTS_TO_DOUBLE_ODDS / math.log(2.0)
    offset = S.SCORE_BASE - factor * math.log(S.ODDS_BASE)
    raw = F.lit(offset) - F.lit(factor) * F.ln(p / (F.lit(1.0) - p))
    return clip(raw, 300.0, 850.0).cast("int")


def log_loss_term(p: Column, positive: bool) -> Column:
    eps = 2.220446049250313e-16
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    return -F.ln(q) if positive else -F.ln(F.lit(1.0) - q)


def normal_two_sided_p(z: Column) -> Column:
    """P(|Z| > z) by the Chebyshev fit of erfc (relative error below 1.2e-7)."""
    # Coefficients of the published fit, constant term first.
    coeff = [
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    ]
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(coeff[-1])
    for k in reversed(coeff[:-1]):
        poly = F.lit(k) + t * poly
    return t * F.exp(-x * x + poly)


def normalised_share(part: Column, total: Column) -> Column:
    return F.try_divide(part, total)


def rounded(name: str, digits: int) -> Column:
    """``F.round`` of a double column, without a decimal number a row: these are made only near a tie and for large values."""
    x, unit = F.col(f"`{name}`"), F.lit(10.0**digits)
    whole = F.rint(x * unit)
    safe = (F.abs(x * unit - whole) < 0.499) & (F.abs(whole) < 1e12)
    return F.when(safe, whole / unit + F.lit(0.0)).otherwise(F.round(x, digits))
