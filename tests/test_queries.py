"""Registered queries against DuckDB on the shared tables.

By default a cross-section runs; TOCSIN_ALL_QUERIES=1 runs every query.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SF = os.environ.get("TOCSIN_SF_DIR", "/root/testdata/sf0.01")
SOME = ("site_false_alarm", "all_thresholds", "operating_results", "cumulative_false_alerts", "weighted_auroc", "bootstrap_summary",
        "target_partitions", "subgroup_summary", "exclusion_reasons", "window_slope", "replicate_summary", "maxima_distribution")
NAMES = sorted(oracle_sql()) if os.environ.get("TOCSIN_ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).count() == 2


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, name):
    assert compare(queries()[name](spark, SF), connect(SF), oracle_sql()[name]) is None
