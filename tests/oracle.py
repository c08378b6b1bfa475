"""Run a registered query next to its SQL and compare the two results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else repr(v + 0.0))
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """None if equal, else a short description of the difference."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want_cols, want = rows_of(names, res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"row count {len(got)} != {len(want)}; spark {got[:2]} oracle {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. spark {bad[0][0]} oracle {bad[0][1]} cols {got_cols}"
    return None if got else "no rows"


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                diff = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                diff = None if n else "no rows"
        except Exception as e:  # noqa: BLE001 - the report names the failure
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        mark = "ok  " if diff is None else "FAIL"
        print(f"{mark} {name:32s} {time.time() - t:6.2f}s {'' if name in oracles else '(rows only) '}{diff or ''}", flush=True)
        if diff:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
