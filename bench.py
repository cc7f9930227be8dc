"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the test tables, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from querybook import QUERIES
from querybook.check import local_session

HEADLINES = [
    # ingest of the raw rows
    "b3_host_totals", "b4_referrer_rollup", "b5_landing_rollup", "b5_beacon_rollup_one_pass",
    "b6_zone_rollup", "b7_zone_top_paths", "b11_top_referrers", "b12_top_pages", "x1_failing_paths",
    # floods and per-site aggregates
    "e3_classify_floods", "e4_split_day", "e9_verified_bots", "f1_site_traffic_30d", "f3_site_sources",
    "f10_top_landing_card", "f14_sparkline",
    # totals and search
    "t9_median_position", "t10_expected_ctr_mix", "t11_traffic_trend", "t12_search_trend",
    "o1_classify_opportunity", "o2_rank_opportunities", "t18_top_opportunities",
    # decisions
    "h1_error_spike", "h7_traffic_drop", "x4_recurrence", "k1_forum_report", "l1_daily_digest",
    # whole reports, by way of the stored tables
    "f17_site_report_7d", "h10_rank_signals_7d", "t_report_totals", "s2_replace_scope", "s5_json_export",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    # Start the JVM's code generation and the Parquet reader before the clock.
    QUERIES["b3_host_totals"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
