"""Quantiles of many columns at once, exact at any size.

Linear interpolation between order statistics at position (n-1)*p.

Wanted ranks are narrowed by counting: each pass counts cells between the
current bounds of a rank, so only (column, cell) counts are shuffled and no task
ever holds the values of a column. Passes alternate between cells of equal width
and of equal width on an inverse-sinh scale, so values of any spread part soon; each
pass shrinks every open zone, as its bounds lie in different cells. A zone is settled when its
bounds have met or hold only two rows. Infinite values are counted apart; NaN counts as missing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CELL_BUDGET = 200_000


@dataclass
class _Zone:
    """The ``rows`` values between lo and hi hold the wanted ranks; ``below`` rows precede."""

    lo: float
    hi: float
    below: int
    rows: int
    ranks: set[int] = field(default_factory=set)


def _as_columns(cols: Sequence[str] | Mapping[str, Column]) -> dict[str, Column]:
    if isinstance(cols, Mapping):
        return {k: v.cast("double") for k, v in cols.items()}
    return {c: F.col(f"`{c}`").cast("double") for c in cols}


def _lit_array(probs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in probs])


def quantiles(
    df: DataFrame,
    cols: Sequence[str] | Mapping[str, Column],
    probs: Sequence[float],
    mode: str = "exact",
    accuracy: int = 10_000,
) -> dict[str, list[float] | None]:
    """``{name: [value per prob]}``; a column without values gives None.

    What reaches the driver is one row per column, or the bounded cell counts.
    """
    exprs = _as_columns(cols)
    if not exprs:
        return {}
    names = list(exprs)
    narrow = df.select(*[exprs[c].alias(f"_{i}") for i, c in enumerate(names)])
    if mode == "approx":
        row = narrow.agg(
            *[F.percentile_approx(f"_{i}", _lit_array(probs), accuracy).alias(f"q{i}") for i in range(len(names))]
        ).first()
        return {c: row[f"q{i}"] for i, c in enumerate(names)}

    narrow = narrow.select(*[F.nanvl(f"_{i}", F.lit(None).cast("double")).alias(f"_{i}") for i in range(len(names))])
    aggs = []
    for i in range(len(names)):
        v = F.col(f"_{i}")
        inside = F.when(F.abs(v) < math.inf, v)
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v == -math.inf).alias(f"low{i}"), F.count(inside).alias(f"in{i}"),
                 F.min(inside).alias(f"lo{i}"), F.max(inside).alias(f"hi{i}")]
    stats = narrow.agg(*aggs).first()
    wanted, found, zones = {}, {}, {}
    for i in range(len(names)):
        n, low, inside = stats[f"n{i}"], stats[f"low{i}"], stats[f"in{i}"]
        wanted[i] = [(n - 1) * p for p in probs] if n else []
        ranks = {r for pos in wanted[i] for r in (math.floor(pos), math.ceil(pos))}
        found[i] = {r: -math.inf if r < low else math.inf for r in ranks if not low <= r < low + inside}
        zones[i] = [_Zone(stats[f"lo{i}"], stats[f"hi{i}"], low, inside, ranks - found[i].keys())] if ranks - found[i].keys() else []
    _settle(zones, found)
    by_width = True
    while any(zones.values()):
        zones = _narrow(narrow, zones, by_width)
        _settle(zones, found)
        by_width = not by_width
    return {c: _interpolate(wanted[i], found[i]) if wanted[i] else None for i, c in enumerate(names)}


def _settle(zones: dict[int, list[_Zone]], found: dict[int, dict[int, float]]) -> None:
    """Move zones whose bounds have met, or hold two rows, into the results."""
    for i, zs in zones.items():
        for z in zs:
            if z.lo == z.hi or z.rows == 2:
                found[i].update({r: z.lo if r == z.below else z.hi for r in z.ranks})
        zones[i] = [z for z in zs if z.lo != z.hi and z.rows > 2]


def _narrow(narrow: DataFrame, zones: dict[int, list[_Zone]], by_width: bool) -> dict[int, list[_Zone]]:
    open_zones = sum(len(z) for z in zones.values())
    cells = max(16, min(1024, _CELL_BUDGET // open_zones))
    active = [i for i, z in zones.items() if z]
    width = max(len(zones[i]) for i in active)

    def bounds(pick) -> Column:
        """Zone bounds by column number; columns with fewer zones end in infinity."""
        rows = [[pick(z) for z in zones[i]] for i in active]
        return F.expr("array(" + ", ".join(
            "array(" + ", ".join([f"{v!r}D" for v in r] + ["double('infinity')"] * (width - len(r))) + ")" for r in rows
        ) + ")")

    parts = ", ".join(f"{k}, _{i}" for k, i in enumerate(active))
    v, f = F.col("v"), F.col("f")
    rows = (
        narrow.selectExpr(f"stack({len(active)}, {parts}) as (f, v)").where("v is not null")
        .withColumn("_l", F.get(bounds(lambda z: z.lo), f)).withColumn("_h", F.get(bounds(lambda z: z.hi), f))
    )
    zone = F.lit(-1)
    for k in range(width):
        zone = zone + (v >= F.get("_l", F.lit(k))).cast("int")
    placed = (
        rows.withColumn("z", zone).where("z >= 0")
        .withColumn("lo", F.get("_l", F.col("z"))).withColumn("hi", F.get("_h", F.col("z"))).where("v <= hi")
    )
    # Halves, so that the range of the largest doubles does not overflow.
    at, lo, hi = (x / 2 if by_width else F.asinh(x) for x in (v, F.col("lo"), F.col("hi")))
    # On the second scale two bounds may fall together; then only the upper one leaves its cell.
    share = F.coalesce(F.try_divide(at - lo, hi - lo), F.lit(0.0))
    step = F.when(v == F.col("hi"), cells - 1).otherwise(F.least(F.floor(share * F.lit(float(cells))), F.lit(cells - 2)))
    counted = (
        placed.groupBy("f", (F.col("z").cast("long") * cells + step).alias("c"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    by_zone: dict[tuple[int, int], list] = {}
    for r in sorted(counted, key=lambda r: (r["f"], r["c"])):
        by_zone.setdefault((active[r["f"]], r["c"] // cells), []).append(r)
    out: dict[int, list[_Zone]] = {i: [] for i in zones}
    for i in active:
        for k, z in enumerate(zones[i]):
            below = z.below
            for r in by_zone[(i, k)]:
                inside = {q for q in z.ranks if below <= q < below + r["n"]}
                if inside:
                    out[i].append(_Zone(r["lo"], r["hi"], below, r["n"], inside))
                below += r["n"]
    return out


def _interpolate(positions: list[float], by_rank: dict[int, float]) -> list[float]:
    out = []
    for pos in positions:
        a, b = by_rank[math.floor(pos)], by_rank[math.ceil(pos)]
        out.append(a if a == b else _between(a, b, pos - math.floor(pos)))
    return out


def _between(a: float, b: float, share: float) -> float:
    """a (1 - share) + b share, rounded like the SQL's ``quantile_cont``: the first product and the sum at once.

    Between values a few last places apart the rounding decides on which side of the quantile they lie.
    """
    if math.isinf(a) or math.isinf(b):
        return a * (1.0 - share) + b * share
    return float(Fraction(a) * Fraction(1.0 - share) + Fraction(b * share))


def distinct_edges(values: Sequence[float] | None) -> list[float]:
    """Ascending edges with repeats removed."""
    return sorted(set(values)) if values else []
