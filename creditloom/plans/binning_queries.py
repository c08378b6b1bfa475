"""Binning, weight of evidence, information value."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators import binning as B
from creditloom.plans.catalog import query
from creditloom.plans.sqltext import APPS, binned
from creditloom.sources.testbed import applications

FEATURES = [*S.BUREAU, *S.BEHAVIOURAL, *S.CLEANER_DEMOGRAPHIC]

_COUNTS = """
, cnt AS (SELECT feature, bin, sum(y)::BIGINT AS n_events, (count(*) - sum(y))::BIGINT AS n_non_events, any_value(len(e)) AS ne
          FROM binned GROUP BY feature, bin)
"""
_FLOOR = _COUNTS + """
, tot AS (SELECT *, greatest(n_events::DOUBLE / greatest(sum(n_events) OVER p, 1)::DOUBLE, 1e-8) AS de,
                 greatest(n_non_events::DOUBLE / greatest(sum(n_non_events) OVER p, 1)::DOUBLE, 1e-8) AS dn
          FROM cnt WHERE bin IS NOT NULL AND ne > 1 WINDOW p AS (PARTITION BY feature))
, woe AS (SELECT feature, bin, n_events, n_non_events, de, dn, ln(de / dn) AS woe, (de - dn) * ln(de / dn) AS iv FROM tot)
"""
_ADD = _COUNTS + """
, tot AS (SELECT *, (n_events + 1e-6) / (sum(n_events) OVER p + 1e-6) AS de,
                 (n_non_events + 1e-6) / (sum(n_non_events) OVER p + 1e-6) AS dn
          FROM cnt WHERE ne > 1 WINDOW p AS (PARTITION BY feature))
, woe AS (SELECT feature, bin, n_events, n_non_events, de, dn, ln(de / dn) AS woe, (de - dn) * ln(de / dn) AS iv
          FROM tot WHERE bin IS NOT NULL)
"""
_STRENGTH = "CASE WHEN iv < 0.02 THEN 'Not predictive' WHEN iv < 0.10 THEN 'Weak' WHEN iv < 0.30 THEN 'Medium' ELSE 'Strong' END"
_STATUS = ("CASE WHEN iv < 0.02 THEN 'Useless' WHEN iv < 0.10 THEN 'Weak' WHEN iv < 0.30 THEN 'Medium' "
           "WHEN iv < 0.50 THEN 'Strong' ELSE 'Suspicious (leakage?)' END")
_BINNED = APPS + binned(FEATURES)
_IV = _BINNED + _FLOOR + """
, iv AS (SELECT f.feature, coalesce(sum(woe.iv), 0e0) AS iv FROM (SELECT DISTINCT feature FROM lng) f
         LEFT JOIN woe ON f.feature = woe.feature GROUP BY f.feature)
"""


@query("quantile_bins", _BINNED + "SELECT feature, bin, count(*) AS n_rows FROM binned WHERE bin IS NOT NULL GROUP BY feature, bin")
def quantile_bins(spark, sf):
    df = applications(spark, sf)
    edges = B.quantile_edges(df, FEATURES, 10)
    bins = {f: B.bin_id(F.col(f).cast("double"), e) for f, e in edges.items()}
    return (
        B.bin_rows(df, bins, S.TARGET).where("bin is not null")
        .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n_rows"))
    )


@query(
    "equal_width_bins",
    APPS + """
, lim AS (SELECT min(loan_amount_requested) AS lo, max(loan_amount_requested) AS hi FROM applications)
, edg AS (SELECT [lo + i * ((hi - lo) / 10) FOR i IN range(1, 10)] AS e FROM lim)
SELECT len(list_filter(e, lambda x: x < loan_amount_requested)) AS bin, count(*) AS n_rows
FROM applications, edg GROUP BY 1
""",
)
def equal_width_bins(spark, sf):
    df = applications(spark, sf)
    edges = B.equal_width_edges(df, ["loan_amount_requested"], 10)["loan_amount_requested"]
    return df.groupBy(B.bin_id("loan_amount_requested", edges).alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "woe_iv_table",
    _BINNED + _FLOOR + """
SELECT feature, bin, n_events, n_non_events, round(de, 8) AS dist_events, round(dn, 8) AS dist_non_events,
       round(woe, 6) AS woe, round(iv, 8) AS iv FROM woe
""",
)
def woe_iv_table(spark, sf):
    t = B.woe_iv_table(applications(spark, sf), FEATURES)
    return t.select(
        "feature", "bin", "n_events", "n_non_events",
        F.round("dist_events", 8).alias("dist_events"), F.round("dist_non_events", 8).alias("dist_non_events"),
        F.round("woe", 6).alias("woe"), F.round("iv", 8).alias("iv"),
    )


@query(
    "woe_fit",
    _BINNED + _ADD + """
SELECT feature, bin, n_events, n_non_events, round(woe, 6) AS woe, round(iv, 8) AS iv FROM woe
""",
)
def woe_fit(spark, sf):
    enc = B.WoeEncoder().fit(applications(spark, sf), FEATURES)
    return enc.table.select(
        "feature", "bin", "n_events", "n_non_events", F.round("woe", 6).alias("woe"), F.round("iv", 8).alias("iv")
    )


@query(
    "woe_transform",
    APPS + binned(FEATURES, keep="default_flag AS y, application_id", kept="y, application_id") + _ADD + """
, sel AS (SELECT feature FROM woe GROUP BY feature HAVING sum(iv) >= 0.02)
SELECT b.feature, count(*) AS n_rows, round(sum(coalesce(w.woe, 0e0)), 3) AS sum_woe, round(max(coalesce(w.woe, 0e0)), 6) AS max_woe
FROM binned b JOIN sel ON b.feature = sel.feature LEFT JOIN woe w ON b.feature = w.feature AND b.bin = w.bin
GROUP BY b.feature
""",
)
def woe_transform(spark, sf):
    df = applications(spark, sf)
    enc = B.WoeEncoder().fit(df, FEATURES)
    coded = enc.transform(df)
    cols = [c for c in coded.columns if c.endswith("_woe")]
    parts = ", ".join(f"'{c[:-4]}', `{c}`" for c in cols)
    return (
        coded.selectExpr(f"stack({len(cols)}, {parts}) as (feature, woe)").groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("woe"), 3).alias("sum_woe"),
            F.round(F.max("woe"), 6).alias("max_woe"),
        )
    )


@query(
    "lookup_join",
    APPS + binned(FEATURES, keep="default_flag AS y, application_id", kept="y, application_id") + _ADD + """
SELECT b.feature, coalesce(b.bin, -1) AS bin, count(*) AS n_rows, round(avg(coalesce(w.woe, 0e0)), 6) AS woe
FROM binned b LEFT JOIN woe w ON b.feature = w.feature AND b.bin = w.bin GROUP BY b.feature, b.bin
""",
)
def lookup_join(spark, sf):
    """Weights looked up, row by row, by a join on the parameter table (features x bins rows)."""
    df = applications(spark, sf)
    edges = B.quantile_edges(df, FEATURES, 10)
    params = B.evidence(B.bin_counts(df, edges, S.TARGET), "additive").select("feature", "bin", "woe")
    bins = {f: B.bin_id(F.col(f), e) for f, e in edges.items()}
    coded = B.bin_rows(df, bins, S.TARGET).join(params, ["feature", "bin"], "left")
    return coded.groupBy("feature", F.coalesce("bin", F.lit(-1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.coalesce("woe", F.lit(0.0))), 6).alias("woe")
    )


@query(
    "iv_strength_table",
    _BINNED + _ADD + f"""
, iv AS (SELECT feature, sum(iv) AS iv FROM woe GROUP BY feature)
SELECT feature, round_even(iv, 4) AS iv, {_STRENGTH} AS strength FROM iv
""",
)
def iv_strength_table(spark, sf):
    return B.WoeEncoder().fit(applications(spark, sf), FEATURES).iv_table()


@query(
    "iv_select",
    _IV + f"SELECT feature, round(iv, 8) AS iv, {_STATUS} AS status, iv >= 0.02 AS selected FROM iv",
)
def iv_select(spark, sf):
    sel = B.IvSelector(flag_leakage=False).fit(applications(spark, sf), FEATURES)
    return sel.report().withColumn("iv", F.round("iv", 8))


@query(
    "default_rate_by_bin",
    _BINNED + "SELECT feature, bin, round(avg(y) * 100, 6) AS default_rate_pct, count(*) AS n_obs FROM binned WHERE bin IS NOT NULL AND len(e) > 1 GROUP BY feature, bin",
)
def default_rate_by_bin(spark, sf):
    out = B.default_rate_by_bin(applications(spark, sf), FEATURES)
    return out.withColumn("default_rate_pct", F.round("default_rate_pct", 6))


@query(
    "iv_by_group",
    _IV + f"""
SELECT feature, round(iv, 8) AS iv,
       CASE WHEN feature IN ({', '.join(repr(f) for f in S.BUREAU)}) THEN 'bureau'
            WHEN feature IN ({', '.join(repr(f) for f in S.BEHAVIOURAL)}) THEN 'behavioural' ELSE 'other' END AS source,
       iv >= 0.02 AS above_minimum, iv > 0.50 AS above_leakage
FROM iv
""",
)
def iv_by_group(spark, sf):
    df = applications(spark, sf)
    out = B.iv_by_group(B.iv_totals(B.woe_iv_table(df, FEATURES), FEATURES))
    return out.withColumn("iv", F.round("iv", 8))


@query(
    "min_bin_merge",
    "WITH RECURSIVE" + APPS.removeprefix("WITH") + binned(FEATURES) + """
, merging(feature, step, size, b) AS (
  SELECT feature, 0, any_value(size), list({'bin': bin, 'last_bin': bin, 'n': n, 'e': e} ORDER BY bin)
  FROM (SELECT feature, bin, count(*) AS n, sum(y)::BIGINT AS e FROM binned WHERE bin IS NOT NULL GROUP BY ALL), (SELECT floor(0.12e0 * count(*))::BIGINT AS size FROM applications)
  GROUP BY feature
  UNION ALL
  SELECT feature, step + 1, size, b[:a - 1] || [{'bin': b[a].bin, 'last_bin': b[a + 1].last_bin, 'n': b[a].n + b[a + 1].n, 'e': b[a].e + b[a + 1].e}] || b[a + 2:]
  FROM (
    SELECT *, CASE WHEN i = 1 THEN 1 WHEN i = len(b) OR b[i - 1].n <= b[i + 1].n THEN i - 1 ELSE i END AS a
    FROM (SELECT *, list_position(list_transform(b, lambda x: x.n), list_min(list_transform(b, lambda x: x.n))) AS i FROM merging)
    WHERE len(b) > 1 AND b[i].n < size
  )
)
SELECT feature, r.bin::INTEGER AS bin, r.last_bin::INTEGER AS last_bin, r.n AS n, r.e AS n_events, r.e / r.n::DOUBLE AS default_rate
FROM (SELECT feature, unnest(arg_max(b, step)) AS r FROM merging GROUP BY feature)
""",
)
def min_bin_merge(spark, sf):
    df = applications(spark, sf)
    counts = B.bin_counts(df, B.quantile_edges(df, FEATURES, 10), S.TARGET)
    n = df.count()
    return B.merge_small_bins(counts, int(0.12 * n)).withColumn(
        "default_rate", C.normalised_share(F.col("n_events"), F.col("n"))
    )
