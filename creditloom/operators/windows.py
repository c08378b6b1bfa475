"""Point-in-time joins and behavioural features from dated logs.

Nothing after the as-of date is used. The log is first collapsed to one row per
entity and day (map-side partial sums), and as-of points to one row per entity
and date, so a hot entity is bounded by its number of days however many
transactions or applications it has. Points and days then stand in one table, ordered by
day inside their entity, and every window of a point is a range frame that
looks back from it: one read of the log, one shuffle, no pairs. Days that no
point can reach are dropped on the way, by the next point at or after them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from creditloom import schema as S

WEEKS = 13


def assemble(form: DataFrame, *sources: DataFrame, key: str = S.ID) -> DataFrame:
    """Form rows with every source attached; rows without a record keep nulls."""
    return reduce(lambda left, right: left.join(right, key, "left"), sources, form)


def asof_points(df: DataFrame, entity: str, t0: str) -> DataFrame:
    """Distinct (entity, t0) pairs; features are computed once per pair."""
    return df.select(F.col(entity).alias("entity"), F.col(t0).cast("date").alias("t0")).distinct()


def log_span(points: DataFrame, days: int = 90) -> tuple[str, str] | None:
    """First and last day that windows of the as-of points can reach; None without points."""
    row = points.agg(F.date_sub(F.min("t0"), days).cast("string").alias("lo"), F.date_add(F.max("t0"), 1).cast("string").alias("hi")).first()
    return (row["lo"], row["hi"]) if row["lo"] else None


def daily_log(
    log: DataFrame, entity: str, ts: str, amount: str, credit: Column | None = None, extra: Sequence[str] = (),
    span: tuple[str, str] | None = None,
) -> DataFrame:
    """(entity, [extra], day, n, amount, credit): one row per entity and day.

    ``span`` (see ``log_span``) bounds the log from a day on to before another; as
    literals of the column's own type the bounds reach the scan.
    """
    if span:
        lo, hi = (F.lit(d).cast(log.schema[ts].dataType) for d in span)
        log = log.where((F.col(ts) >= lo) & (F.col(ts) < hi))
    credit_amount = F.when(credit, F.col(amount)) if credit is not None else F.lit(None).cast("double")
    return (
        log.where(F.col(ts).isNotNull())
        .groupBy(F.col(entity).alias("entity"), *extra, F.to_date(ts).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"), F.max(credit_amount).alias("credit"),
        )
    )


def _back(first: int, last: int) -> WindowSpec:
    """Days of the entity that lie ``first`` to ``last`` days back."""
    return Window.partitionBy("entity").orderBy(F.desc("_at")).rangeBetween(first, last)


def _points_and_days(points: DataFrame, daily: DataFrame, days: int) -> DataFrame:
    """As-of points (``_ask``) and the log days they reach, with the day number ``_at``."""
    asked = points.withColumns({"_ask": F.lit(True), "_at": F.unix_date("t0")})
    logged = daily.where(F.col("entity").isNotNull() & F.col("day").isNotNull()).withColumns({"_ask": F.lit(False), "_at": F.unix_date("day")})
    next_point = F.min(F.when(F.col("_ask"), F.col("_at"))).over(_back(Window.unboundedPreceding, Window.currentRow))
    both = asked.unionByName(logged, allowMissingColumns=True).withColumn("_next", next_point)
    return both.where(F.col("_ask") | (F.col("_next") - F.col("_at") <= days)).drop("_next")


def asof_window_join(points: DataFrame, daily: DataFrame, days: int = 90, how: str = "left") -> DataFrame:
    """Point x its log days with ``t0 - days <= day <= t0``; adds ``age`` in days.

    With ``how="left"`` a point without such days appears once, with nulls. Points without entity or
    date have no days; log rows without either are left out.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how}")
    fields = [c for c in daily.columns if c != "entity"]
    day = F.when(~F.col("_ask"), F.struct(*fields))
    met = _points_and_days(points, daily, days).withColumn("_met", F.collect_list(day).over(_back(0, days))).where("_ask")
    each = F.explode("_met") if how == "inner" else F.explode_outer("_met")
    return met.select(*points.columns, each.alias("_d")).select(*points.columns, "_d.*", F.datediff("t0", "_d.day").alias("age"))


def behaviour(
    points: DataFrame, daily: DataFrame, regularity_divisor: float = 2.0, salary_tolerance: float = 0.10
) -> DataFrame:
    """All single-log features of each as-of point, from frames over one sorted table.

    * counts and mean amounts over 30, 60 and 90 days (no rows: 0 and null)
    * deviation of 13 weekly totals, empty weeks counting as 0 (sample form)
    * payment regularity from interval sums: the gap before the first
      day of a window is taken out; payments on the same day add zero-length intervals
    * salary regularity: the largest credit of each 30-day period lies within
      the tolerance of their median in at least three periods
    """
    rows = _points_and_days(points, daily, 90).withColumn("_day", F.when(~F.col("_ask"), F.col("_at")))
    gap = F.col("_day") - F.expr("lead(_day) ignore nulls over (partition by entity order by _at desc)")
    rows = rows.withColumn("_gap2", F.coalesce((gap * gap).cast("double"), F.lit(0.0)))
    whole = _back(0, 90)
    framed = {}
    for w in (30, 60, 90):
        framed[f"txn_frequency_{w}d"] = F.coalesce(F.sum("n").over(_back(0, w)), F.lit(0))
        framed[f"_a{w}"] = F.sum("amount").over(_back(0, w))
    framed |= {f"_w{w}": F.coalesce(F.sum("amount").over(_back(7 * w, 7 * w + 6)), F.lit(0.0)) for w in range(WEEKS)}
    framed |= {
        "_span": (F.max("_day").over(whole) - F.min("_day").over(whole)).cast("double"),
        "_g2": F.sum(F.when(~F.col("_ask"), F.col("_gap2"))).over(whole) - F.min_by("_gap2", "_day").over(whole),
    }
    framed |= {f"_c{p}": F.max("credit").over(_back(30 * p, 90 if p == 2 else 30 * p + 29)) for p in range(3)}
    g = rows.withColumns(framed).where("_ask")

    weekly = [F.col(f"_w{w}") for w in range(WEEKS)]
    mean = sum(weekly[1:], weekly[0]) / float(WEEKS)
    squares = [(x - mean) * (x - mean) for x in weekly]
    volatility = F.sqrt(sum(squares[1:], squares[0]) / float(WEEKS - 1))

    n = F.col("txn_frequency_90d")
    m = (n - 1).cast("double")
    avg_gap = F.col("_span") / m
    deviation = F.sqrt(F.greatest((F.col("_g2") - m * avg_gap * avg_gap) / (m - 1.0), F.lit(0.0)))
    cv = F.try_divide(deviation, avg_gap)
    regularity = F.when(n >= 3, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cv / regularity_divisor)))

    credits = F.array(*[F.col(f"_c{p}") for p in range(3)])
    median = F.get(F.array_sort(credits), F.lit(1))
    near = [(F.abs(F.col(f"_c{p}") - median) <= median * salary_tolerance).cast("int") for p in range(3)]
    steady = sum(near[1:], near[0]) >= 3
    return g.select(
        "entity", "t0",
        *[F.col(f"txn_frequency_{w}d") for w in (30, 60, 90)],
        *[F.try_divide(F.col(f"_a{w}"), F.col(f"txn_frequency_{w}d")).alias(f"avg_txn_amount_{w}d") for w in (30, 60, 90)],
        volatility.alias("spending_volatility_90d"),
        regularity.alias("digital_payment_regularity"),
        F.coalesce(steady.cast("int"), F.lit(0)).alias("salary_credit_regularity"),
    )


def merchant_diversity(points: DataFrame, daily: DataFrame, category: str) -> DataFrame:
    """Distinct categories and normalised spend entropy over 90 days."""
    rows = asof_window_join(points, daily, 90)
    per_category = rows.groupBy("entity", "t0", category).agg(F.sum("amount").alias("x"))
    xlnx = F.when(F.col("x") > 0, F.col("x") * F.ln("x")).otherwise(F.lit(0.0))
    g = per_category.groupBy("entity", "t0").agg(
        F.count(category).alias("merchant_category_diversity"), F.sum("x").alias("_t"), F.sum(xlnx).alias("_s")
    )
    k, t = F.col("merchant_category_diversity"), F.col("_t")
    entropy = (F.ln(t) - F.col("_s") / t) / F.ln(k.cast("double"))
    return g.select(
        "entity", "t0", "merchant_category_diversity",
        F.when((k > 1) & (t > 0), entropy).otherwise(F.lit(0.0)).alias("merchant_entropy"),
    )


def session_cells(events: DataFrame, entity: str, ts: str, gap_seconds: int = 1800) -> DataFrame:
    """entity, second, first, last, n, breaks, active: the sessions of each second (times in microseconds).

    Equal times are counted before anything is ordered, so no ordered group holds more than the moments of one second.
    """
    moments = (
        events.where(F.col(ts).isNotNull()).select(F.col(entity).alias("entity"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
        .groupBy("entity", "t").agg(F.count(F.lit(1)).alias("n"))
    )
    one = F.lit(0).cast("long")
    parts = moments.select("entity", F.floor(F.col("t") / 1_000_000).alias("second"), F.col("t").alias("first"), F.col("t").alias("last"), "n", one.alias("breaks"), one.alias("active"))
    return merge_sessions(parts, ["entity", "second"], gap_seconds)


def merge_sessions(parts: DataFrame, by: Sequence[str], gap_seconds: int) -> DataFrame:
    """One summary per ``by`` from the summaries of its consecutive parts.

    Associative: a summary knows its first and last moment, its breaks and its active time, and
    the pause between two parts is either a break or active time.
    """
    pause = F.col("first") - F.lag("last").over(Window.partitionBy(*by).orderBy("first"))
    linked = parts.withColumn("_pause", pause)
    breaks = F.col("_pause") > gap_seconds * 1_000_000
    return linked.groupBy(*by).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"),
        F.sum(F.col("breaks") + F.coalesce(breaks.cast("long"), F.lit(0))).alias("breaks"),
        F.sum(F.col("active") + F.when(~breaks, F.col("_pause")).otherwise(0)).alias("active"),
    )


def engagement(
    events: DataFrame, entity: str, ts: str, kind: str, gap_seconds: int = 1800,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
) -> DataFrame:
    """Sessions, time in session and breadth of use per entity.

    A pause longer than the gap starts a session. Summaries of seconds are merged to
    hours and these to entities, so that the events of one entity, even of one hour, are
    spread over many tasks.
    """
    cells = session_cells(events, entity, ts, gap_seconds).withColumn("hour", F.floor(F.col("second") / 3600))
    use = merge_sessions(merge_sessions(cells, ["entity", "hour"], gap_seconds), ["entity"], gap_seconds).select(
        "entity", F.col("n").alias("n_events"), (F.col("breaks") + 1).alias("n_sessions"), (F.col("active") / 1e6).alias("session_seconds")
    )
    breadth = events.where(F.col(ts).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.count_distinct(kind).alias("breadth"))
    mean = F.col("session_seconds") / F.col("n_sessions")
    w = [float(x) for x in weights]
    score = F.log1p("n_sessions") * w[0] + F.log1p(mean) * w[1] + F.col("breadth") * w[2]
    return use.join(breadth, "entity").select("*", mean.alias("avg_session_seconds"), score.alias("engagement"))


def default_label(
    points: DataFrame, performance: DataFrame, entity: str, ts: str, dpd: str,
    limit: int = S.DEFAULT_DPD, months: int = S.PERFORMANCE_MONTHS,
) -> DataFrame:
    """1 iff days past due reach the limit within ``[t0, t0 + months]``.

    Late records collapse to distinct days. Points and late days are merged in
    descending order and a running minimum gives the next late day at or after
    each point: linear work, no pairs.
    """
    late = (
        performance.where(F.col(dpd) >= limit)
        .select(F.col(entity).alias("entity"), F.to_date(ts).alias("at")).distinct()
        .select("entity", "at", F.col("at").alias("late"), F.lit(0).alias("kind"))
    )
    asked = points.select("entity", F.col("t0").alias("at"), F.lit(None).cast("date").alias("late"), F.lit(1).alias("kind"))
    back = Window.partitionBy("entity").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(late).withColumn("next_late", F.min("late").over(back)).where("kind = 1")
    hit = F.col("next_late") <= F.add_months("at", months)
    return rows.select("entity", F.col("at").alias("t0"), F.coalesce(hit.cast("int"), F.lit(0)).alias(S.TARGET))
