"""Plan shapes that must hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from creditloom.operators import binning as B
from creditloom.operators import ranking as R
from creditloom.operators import windows as W
from creditloom.plans.window_queries import _daily, _points
from creditloom.sources.testbed import applications, long_scores, table

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plan as if every side were large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize(
    "name",
    ["assemble_applications", "asof_window_join", "rolling_txn", "merchant_diversity", "default_label", "population_filter",
     "target_encode_oof", "auc", "roc_points", "ks_curve", "score_histogram", "delong_test", "stratified_kfold"],
)
def test_no_cross_join_and_no_hint(no_broadcast, sf_dir, name):
    text = plan(QUERIES[name](no_broadcast, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "BroadcastExchange"):
        assert bad not in text


def test_scan_reads_only_needed_columns(spark, sf_dir):
    df = applications(spark, sf_dir)
    edges = {"cic_num_delinquencies": [0.0, 1.0, 5.0]}
    text = B.bin_counts(df, edges, "default_flag")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<default_flag:int,cic_num_delinquencies:double>" in text


def test_filters_reach_the_scan(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    points = W.asof_points(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")
    text = W.default_label(points, log, "l_orderkey", "l_shipdate", "l_quantity", limit=45)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,45.0)" in text


def test_log_is_pruned_to_the_reach_of_the_points(spark, sf_dir):
    text = _daily(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_shipdate,.*LessThan\(l_shipdate,", text)


def test_target_encoding_moves_no_rows(spark, sf_dir):
    text = plan(QUERIES["target_encode_oof"](spark, sf_dir))
    assert "Exchange" not in text and "Join" not in text


def test_window_runs_inside_slices(no_broadcast, sf_dir):
    df = long_scores(no_broadcast, sf_dir)
    cells = R.prefix_sums(R.score_cells(df, "label", "score", ["model"]), "score", ["pos", "neg"], ["model"], [0.25, 0.5])
    text = plan(cells)
    assert re.search(r"Window \[sum\(pos#\d+L\) windowspecdefinition\(model#\d+, _slice#\d+, score", text)
    # Shuffles: cells, cells by slice, and three of the small slice table.
    assert text.count("Exchange hashpartitioning") - text.count("ReusedExchange") <= 6
    left = text.split("SortMergeJoin")[1].split("\n")[1:4]
    assert not any("Exchange" in line for line in left)


def test_as_of_windows_share_one_shuffle(no_broadcast, sf_dir):
    points, daily = _points(no_broadcast, sf_dir), _daily(no_broadcast, sf_dir)
    for out in (W.asof_window_join(points, daily), W.behaviour(points, daily)):
        text = plan(out)
        assert "Join" not in text and len(re.findall(r"Exchange hashpartitioning\(entity#\d+L, \d+\)", text)) == 1
        assert text.count("Sort [entity") == 1
        # The log is read once; the points of these queries come from the same table and are the other read.
        assert text.count("FileScan") == 2


def test_dedupe_limits_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["dedupe_applications"](spark, sf_dir))
    assert text.count("WindowGroupLimit") == 2


def test_projections_do_not_shuffle(spark, sf_dir):
    for name in ("clip_bounds", "missing_flags", "build_behavioral_features", "credit_score", "stratified_split", "adverse_action_top3"):
        assert "Exchange" not in plan(QUERIES[name](spark, sf_dir))
