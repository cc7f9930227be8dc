"""Registered queries on the test tables against their SQL on another engine.

A cross-section by default; TIDEGAUGE_ALL_QUERIES=1 runs every one of them.
"""

import os
from pathlib import Path

import pytest

from querybook import ORACLES, QUERIES
from querybook.check import compare, duck

SF_DIR = os.environ.get("TIDEGAUGE_SF_DIR", "/root/testdata/sf0.01")
SAMPLE = [
    "a1_rum_scan", "a4_ranked_cap", "a6_keyword_scan", "b1_alias_rollup", "b5_beacon_rollup_one_pass",
    "b6_zone_rollup", "b11_top_referrers", "b13_zero_fill_sites", "d4_malformed_url", "d5_expected_ctr",
    "e3_classify_floods", "e9_verified_bots", "f1_site_traffic_30d", "f3_site_sources", "f14_sparkline",
    "h1_error_spike", "h3_likely_bot_subflood", "h9_no_comparison", "k1_forum_report", "n1_property_audit",
    "o1_classify_opportunity", "s2_replace_scope", "t9_median_position", "t11_traffic_trend", "x4_recurrence",
]
NAMES = list(QUERIES) if os.environ.get("TIDEGAUGE_ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == ""


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as driver

    df = driver.entry(spark)
    assert df.columns == ["date", "host", "human", "crawler", "human_views", "crawler_views", "partial"]
    assert df.count() > 0
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql()) <= set(driver.queries())
