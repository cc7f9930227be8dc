"""Flood shapes with known verdicts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import floods as E
from tidegauge.operators import zone as Z

SUSTAINED = [625, 803, 1223, 1431, 5824, 2300, 38131, 21320, 13837, 3021, 19797, 31471, 17118, 9314]
CASES = {
    # name: [(visits, pages per session, direct share)], least and most floods
    "sustained": ([(v, 1.0, 1.0) for v in SUSTAINED], 6, 9),
    "spike": ([(v, 1.0, 1.0) for v in [20] * 11 + [10426, 8809, 63]], 2, 2),
    "human": ([(250, 1.4, 0.6)] * 13 + [(900, 1.5, 0.55)], 0, 0),
    "tiny": ([(40, 1.0, 1.0)] * 14, 0, 0),
    "small growth": ([(30, 1.0, 1.0)] * 13 + [(300, 1.0, 1.0)], 0, 0),
    "viral": ([(200, 1.3, 0.5)] * 13 + [(20000, 1.25, 0.2)], 0, 0),
    "one day": ([(26, 1.4, 0.6)] * 13 + [(1689, 1.08, 0.99)], 1, 1),
    "zone": ([(60, 1.0, None)] * 13 + [(1059, 1.0, None)], 0, 0),
}


def half_up(x):
    return int(x + 0.5)


@pytest.fixture(scope="module")
def classified(spark):
    traffic, kinds = [], []
    for host, (days, _, _) in CASES.items():
        for n, (visits, pps, direct) in enumerate(days):
            date = dt.date(2026, 7, 1 + n)
            traffic.append((date, host, visits, half_up(visits * pps)))
            if direct is not None:  # a request log has no referrer
                part = half_up(visits * direct)
                kinds += [(date, host, "direct", part), (date, host, "search", visits - part)]
    # A direct row on a day that has no traffic row is ignored.
    kinds.append((dt.date(2026, 6, 1), "tiny", "direct", 10**6))
    return E.classify_floods(
        spark.createDataFrame(traffic, "date DATE, host STRING, visits BIGINT, views BIGINT"),
        spark.createDataFrame(kinds, "date DATE, host STRING, kind STRING, visits BIGINT"),
    )


def test_verdicts(classified):
    counts = {r.host: r.n for r in classified.groupBy("host").agg(F.count_if("flood").alias("n")).collect()}
    for host, (days, least, most) in CASES.items():
        assert least <= counts[host] <= most, host
    assert classified.count() == sum(len(days) for days, _, _ in CASES.values())


def test_baseline_is_a_lower_median_or_a_quartile(classified):
    base = {r.host: r.b for r in classified.groupBy("host").agg(F.max("baseline").alias("b")).collect()}
    assert base["one day"] == 26
    # All fourteen days carry the signature: element floor(13 * 0.25) of the sorted visits.
    assert base["sustained"] == sorted(SUSTAINED)[3]


def test_split_of_a_flooded_and_of_a_clean_day(classified):
    rows = {(r.host, r.date.day): r for r in E.split_days(classified).collect()}
    day = rows["one day", 14]
    assert (day.human, day.crawler, day.human_views, day.partial) == (17, 1672, 0, True)
    assert day.crawler_views == half_up(1689 * 1.08)
    clean = rows["one day", 1]
    assert (clean.human, clean.crawler, clean.partial) == (26, 0, False)
    assert rows["zone", 14].human == 1059


def test_one_shuffle_for_shape_and_baseline(classified):
    plan = classified._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_flood_run_counts_back_from_the_report_date(spark):
    d = dt.date
    rows = [
        ("run", d(2026, 8, 9), d(2026, 8, n)) for n in (9, 8, 7, 5)
    ] + [("clean", d(2026, 8, 9), d(2026, 8, 8)), ("later", d(2026, 8, 8), d(2026, 8, 9)),
         ("later", d(2026, 8, 8), d(2026, 8, 8))]
    floods = spark.createDataFrame(rows, "host STRING, as_of DATE, date DATE")
    assert {r.host: r.flood_run for r in E.flood_run(floods).collect()} == {"run": 3, "later": 1}


def test_crawler_route(spark):
    df = spark.createDataFrame([("zone",), ("rum",), (None,)], "m STRING")
    assert [r[0] for r in df.select(Z.crawler_route(F.col("m"))).collect()] == ["zone", "flood", "flood"]


def test_verified_floor(spark):
    rows = [("h", c, r, v) for c, r, v in [
        ("(unverified)", 18538, 900), ("Archiver", 936, 60), ("Search Engine Crawler", 867, 55),
        ("AI Crawler", 696, 40), ("Search Engine Optimization", 446, 30), ("AI Search", 405, 25),
        ("Page Preview", 21, 3), ("Monitoring & Analytics", 10, 2), ("Accessibility", 8, 1), (None, 5, 1),
    ]]
    bots = Z.verified_bots(spark.createDataFrame(rows, "host STRING, category STRING, requests BIGINT, visits BIGINT")).first()
    assert (bots.verified_requests, bots.verified_visits, bots.unverified_requests) == (3389, 216, 18543)
