"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the input tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from creditloom.plans import load  # noqa: E402
from creditloom.sources.testbed import derive_applications  # noqa: E402

HEADLINE = [
    "clean_pipeline", "describe_missing", "range_check", "dedupe_applications", "target_encode_oof",
    "stratified_split", "stratified_split_exact", "build_bureau_features", "build_behavioral_features", "credit_score",
    "assemble_applications", "asof_window_join", "rolling_txn", "payment_regularity", "merchant_diversity",
    "engagement_components", "default_label",
    "quantile_bins", "woe_iv_table", "woe_transform", "iv_select",
    "compare_models", "roc_points", "segment_metrics", "delong_test", "bootstrap_ci",
    "compare_calibration", "reliability_equal_freq", "psi_per_feature", "psi_monthly", "correlation_pairs", "density_by_class",
    "attribution_linear", "mean_abs_attribution", "adverse_action_top3",
    "train_boosted", "attribution_tree", "train_logistic", "train_forest", "smote",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("creditloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        # Small local inputs: let a few hundred KB make a partition of their own.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    run(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    times: dict[str, float] = {}
    start = time.perf_counter()
    run(derive_applications(spark, sf_dir))
    times["derive_applications"] = round(time.perf_counter() - start, 3)
    only = sys.argv[1:]
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        run(queries[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
