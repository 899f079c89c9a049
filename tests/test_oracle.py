"""Every query with reference SQL agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

DIRECTORY = "/root/testdata/sf0.01"
SQL = entry.oracle_sql()
# a cross-section that keeps the suite short; tests/check_queries.py runs them all
CHOSEN = [
    "regime_share", "label_rows", "own_trailing", "neighbour_tier", "neighbour_tier_joined", "upstream_tier", "yearly_quality",
    "duplicate_summary", "align_overlap", "mask_faults", "brier_rps", "auc_pr", "rps_by_slice", "wet_day_transition", "lagged_corr",
    "rank_test", "block_bootstrap", "point_in_region", "stratified_sample", "serve_counting", "season_motion",
]


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, DIRECTORY), con, SQL[name]) == []


def test_names_and_sql_belong_together():
    assert set(SQL) <= set(entry.queries())
    assert not [n for n, text in SQL.items() if text.count("(") != text.count(")")]


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r["regime"] for r in rows} <= {"dry_now", "wet_now", "unknown"} and sum(r["n"] for r in rows) == 34
