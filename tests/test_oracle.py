"""Every registered query with SQL against DuckDB; the others must give rows."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture
def con(sf_dir):
    """A database of its own for each query: a fault in one cannot fail the others."""
    own = connect(sf_dir)
    own.execute("SET threads = 4")
    own.execute("SET memory_limit = '4GB'")
    yield own
    own.close()


#: Queries that rightly return no row at this scale.
EMPTY: set[str] = set()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    found = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert found is None or found == "no rows" and name in EMPTY


@pytest.mark.parametrize("name", ["min_bin_merge", "bootstrap_ci", "coefficients", "tree_importance", "attribution_tree", "smote"])
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).collect()


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["feature", "bin", "n_events"]
