"""The report of the estate against its known answers."""

import datetime as dt
import json
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests import estate as X
from tidegauge.config import SiteConfig
from tidegauge.operators import digest as L
from tidegauge.operators import forums as K
from tidegauge.operators import opportunities as O
from tidegauge.operators import panels as M
from tidegauge.operators import reads as R
from tidegauge.operators import signals as H
from tidegauge.operators import sites as P
from tidegauge.operators import totals as T
from tidegauge.operators import zone as Z
from tidegauge.plans.report import Report


def make(spark, days=1, config=X.CONFIG, **changes):
    return Report(X.tables(spark, **changes), config, R.Period(X.LAST, days))


@pytest.fixture(scope="module")
def day_report(spark):
    return make(spark)


@pytest.fixture(scope="module")
def site_rows(day_report):
    return {r.host: r for r in day_report.site_rows.collect()}


@pytest.fixture(scope="module")
def totals(day_report):
    return day_report.totals.first()


@pytest.fixture(scope="module")
def found(day_report):
    return [r for r in H.rank_signals(day_report.signals()).collect()]


def kinds(found, host):
    return sorted(s.kind for s in found if s.host == host)


def test_flooded_only_day_is_a_floor(site_rows, day_report):
    site = site_rows[X.FLOODED]
    assert (site.visits, site.partial_visits, site.partial_days, site.clean_days) == (17, 17, 1, 0)
    assert (site.bot_visits, site.views, site.pages_per_session) == (1672, 0, 0)
    assert site.delta is None and site.previous_visits == 34
    assert site.search == 17 and site.direct == 0
    assert site.anomaly == "99% direct, 1.1 pages/session, 94x a normal day"
    kept = day_report.referrers.where(F.col("host") == X.FLOODED).collect()
    assert [(r.referrer, r.visits) for r in kept] == [("www.google.com", 17)]


def test_mixed_week_counts_clean_days_whole(spark):
    site = make(spark, 7).traffic.where(F.col("host") == X.FLOODED).first()
    clean = [(v, X.jround(v * pps)) for d, v, _, pps in X.FLOODED_DAYS[-7:-2]]
    visits, views = (sum(column) for column in zip(*clean))
    assert (site.clean_days, site.partial_days) == (5, 2)
    assert site.visits == visits + 34 + 17 and site.views == views
    assert site.pages_per_session == pytest.approx(views / visits)


def test_measurement_classes_stay_apart(site_rows, totals, day_report):
    assert (totals.visits, totals.views) == (17 + 151 + 40, 151 + 82)
    assert (totals.zone_visits, totals.zone_requests, totals.zone_bytes) == (1059, 19506, 76_658_000_000)
    assert (totals.zone_sites, totals.zone_hosts) == (1, X.ZONE)
    assert totals.pages_per_session == pytest.approx(233 / 208)
    assert (totals.domains, totals.rum_domains, totals.zone_domains, totals.active) == (13, 12, 1, 4)
    assert site_rows[X.ZONE].bot_days == 0
    for sort in R.SORTS:
        assert P.site_order(day_report.traffic, sort).collect()[-1].host == X.ZONE


def test_site_order_within_a_class(day_report):
    hosts = [r.host for r in P.site_order(day_report.traffic, "traffic").collect()]
    assert hosts[:3] == [X.SUBFLOOD, X.SMALL, X.FLOODED]
    names = [r.host for r in P.site_order(day_report.traffic, "name").collect()]
    assert names[:-1] == sorted(names[:-1])
    by_change = [r.host for r in P.site_order(day_report.traffic, "change").collect()]
    assert by_change[:2] == [X.SUBFLOOD, X.SMALL]


def test_zone_lenses(day_report):
    bots = Z.verified_bots(day_report.rows("zone_bots", "date")).first()
    assert (bots.verified_requests, bots.verified_visits, bots.unverified_requests) == (3389, 216, 16117)
    assert bots.verified_share < 0.2 and bots.measured
    categories = Z.verified_categories(day_report.rows("zone_bots", "date")).collect()
    assert len(categories) == 6 and categories[0].category == "Archiver"
    lens = Z.non_content_totals(
        day_report.rows("zone_pages", "date"), day_report.rows("zone_status", "date")
    ).first()
    assert (lens.path_requests, lens.error_requests) == (956, 2514)
    assert not [c for c in [*bots.__fields__, *lens.__fields__] if "human" in c or c == "requests"]


def test_missing_table_is_unmeasured_not_zero(spark):
    report = make(spark, zone_bots=None)
    zone = report.sites.where(F.col("host") == X.ZONE).drop("measurement")
    bots = Z.verified_bots(report.rows("zone_bots", "date"), zone).first()
    assert not bots.measured and bots.verified_requests == 0
    assert report.traffic.where(F.col("host") == X.ZONE).first().visits == 1059


def test_signals_of_every_host(found):
    assert kinds(found, X.SUBFLOOD) == ["likely-bot-subflood"]
    assert kinds(found, X.ZONE) == ["error-spike"]
    assert kinds(found, X.SMALL) == []
    assert kinds(found, X.BLOG) == ["malformed-urls"]
    assert kinds(found, X.FLOODED) == ["no-comparison"]
    assert kinds(found, X.WALLET) == ["rank-gap", "snippet-gap"]
    assert kinds(found, X.FORUM) == ["snippet-gap"]
    assert [s.severity for s in found] == sorted(s.severity for s in found)
    assert all(s.href == "#site-" + s.host.replace(".", "-") for s in found)


def test_signal_texts(found):
    by_kind = {(s.host, s.kind): s for s in found}
    spike = by_kind[X.ZONE, "error-spike"]
    assert spike.headline == "files.example error responses are 12.9% of requests"
    assert spike.evidence == (
        "2,514 responses ≥ 400 out of 19,506 requests, against a 4-day mean of 1.1%."
    )
    crawler = by_kind[X.SUBFLOOD, "likely-bot-subflood"]
    assert crawler.headline == (
        "wiki.example is up 180%, and it looks like a crawler rather than growth"
    )
    assert crawler.evidence == (
        "151 sessions (was 54), 90% direct, 1.0 pages/session,"
        " 89% of entrances on /wiki/Main_Page."
    )
    urls = by_kind[X.BLOG, "malformed-urls"]
    assert urls.headline == "blog.example is serving 3 malformed URLs"
    assert urls.evidence.endswith("e.g. /category/a/%3E%C3%97%3C/span%3E8%3C/span%3E.")
    floor = by_kind[X.FLOODED, "no-comparison"]
    assert floor.recurrence == 2
    assert floor.evidence.startswith("17 sessions is a floor: this period contains")
    snippet = by_kind[X.FORUM, "snippet-gap"]
    assert 'led by "forum lead" at position 4.5 with 1.3% CTR' in snippet.evidence
    assert by_kind[X.SHEETS, "snippet-gap"].headline == (
        "sheets.example has 1 query ranking well but not clicked"
    )
    assert "5 queries ranking too deep" in by_kind[X.WALLET, "rank-gap"].headline


def test_actions_and_alert(day_report, found):
    actions = H.todays_actions(day_report.signals()).collect()
    assert [a.kind for a in actions[:2]] == ["error-spike", "likely-bot-subflood"]
    assert len(actions) == 3 and all(a.severity <= 2 for a in actions)
    assert H.top_alert(day_report.signals()).first().kind == "error-spike"


def test_source_mix(totals, site_rows):
    assert (totals.unattributed, totals.internal, totals.referral) == (2, 6, 2)
    channels = ("direct", "search", "social", "referral", "internal", "unattributed")
    assert sum(totals[c] for c in channels) == totals.visits
    assert totals.internal_measured
    assert (site_rows[X.SMALL].internal, site_rows[X.SMALL].unattributed) == (6, 2)


@pytest.mark.parametrize("days", [7, 30])
def test_channel_that_was_never_stored_is_absent(spark, days):
    old = [r for r in X.REFERRERS if r[3] != "internal"]
    report = make(spark, days, referrers=old)
    mix = T.source_mix(report.sources)
    measured = T.internal_measured(report.period_referrers, report.sites)
    assert not measured.first().internal_measured and mix.first().internal == 0
    shares = M.channel_share(mix, measured, T.rum_totals(report.traffic)).collect()
    assert "internal" not in [r.channel for r in shares]
    assert sum(r.share for r in shares) == pytest.approx(1.0)


def test_comparators(totals):
    assert totals.trend_days == 14
    assert f"{totals.visits_per_day:.1f} {totals.views_per_day:.1f} {totals.search_per_day:.1f}" == "40.2 49.9 15.0"
    assert totals.snapshots == 5
    assert f"{totals.clicks_per_snapshot:.1f} {totals.impressions_per_snapshot:.0f}" == "10.2 2192"
    assert totals.trend_ctr == pytest.approx(51 / 10958)
    assert (totals.window_first, totals.window_last) == (
        "2026-08-01–2026-08-03", "2026-08-05–2026-08-07",
    )


def test_search_totals_and_sample(totals):
    assert (totals.clicks, totals.impressions, totals.search_domains) == (9, 2250, 3)
    assert totals.search_ctr == pytest.approx(0.004)
    assert (totals.sample_queries, totals.sample_impressions, totals.sample_clicks) == (15, 954, 7)
    assert totals.sample_ctr == pytest.approx(7 / 954)
    assert totals.sample_share == pytest.approx(954 / 2250) and not totals.thin_sample
    assert totals.expected_ctr > totals.sample_ctr
    assert (totals.median_position, totals.position_queries, totals.top10_queries) == (12.8, 13, 5)
    assert totals.weighted_position > totals.median_position


def test_opportunities(day_report, totals):
    rows = {r["query"]: r for r in day_report.opportunities.collect()}
    assert (totals.snippet_opportunities, totals.rank_opportunities) == (7, 5)
    assert rows["w1"].kind == "rank" and rows["w1"].lost_clicks is None
    assert rows["w1"].potential_clicks == pytest.approx(0.936, abs=5e-4)
    assert not {"too deep", "not worth it", "performs"} & set(rows)
    ranked = O.rank_opportunities(day_report.opportunities).collect()
    assert [r["query"] for r in ranked if r.host == X.FORUM][0] == "forum lead"
    for host in (X.WALLET, X.FORUM, X.SHEETS):
        for kind in ("snippet", "rank"):
            scores = [r.score for r in ranked if (r.host, r.kind) == (host, kind)]
            assert scores == sorted(scores, reverse=True)
    reason = O.flag_keywords(O.classify_keywords(day_report.keywords)).where("query = 'w1'").first()
    assert reason.is_opportunity and reason.reason.startswith(
        "Ranks at 31.2, too deep to be seen. Roughly 0.9 clicks"
    )


def test_classification_is_not_written_out_in_a_filter(day_report):
    plan = day_report.opportunities._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("POWER" in line for line in filters)


def test_denied_queries_stay_listed_but_are_no_opportunity(spark):
    sites = tuple(
        replace(s, deny_patterns=("^W1$", "(unclosed")) if s.host == X.WALLET else s
        for s in X.CONFIG.sites
    )
    report = make(spark, config=SiteConfig(sites))
    queries = {r["query"] for r in report.opportunities.collect()}
    assert "w1" not in queries and len(queries) == 11
    assert report.keywords.where("query = 'w1'").count() == 1


def test_deep_tail_adds_no_opportunity(spark):
    tail = [(X.FORUM, f"tail {i}", 0, 1, 30.0 + i % 66) for i in range(440)]
    tail += [(X.FORUM, f"deep {i}", 0, 12, 70.0 + i % 21) for i in range(45)]
    report = make(spark, keywords=X.keywords(X.KEYWORD_ROWS + tail))
    counts = O.opportunity_totals(report.opportunities).first()
    assert (counts.snippet, counts.rank) == (7, 5)
    median = T.median_position(report.keywords).first()
    eligible = [p for _, _, _, i, p in X.KEYWORD_ROWS + tail if i >= 10]
    assert median.position_queries == len(eligible) == 13 + 45
    assert median.median_position == pytest.approx(statistics.median(eligible))
    assert median.top10_queries == 5


def test_latest_only_panels_and_window(site_rows, day_report):
    assert site_rows[X.FORUM].search_window == "2026-08-05–2026-08-07"
    assert site_rows[X.FORUM].search_clicks == 6 and site_rows[X.FORUM].has_search
    assert not site_rows[X.BLOG].has_search and site_rows[X.BLOG].search_clicks is None
    assert day_report.keywords.where(F.col("host") == X.FORUM).count() == 6
    spark_rows = P.sparkline(day_report.split).where(F.col("host") == X.FLOODED).collect()
    assert len(spark_rows) == 14 and sum(r.flood for r in spark_rows) == 2


def test_empty_estate(spark):
    report = Report(X.tables(spark, **dict.fromkeys(X.ROWS)), X.CONFIG, R.Period(X.LAST))
    totals = report.totals.first()
    assert (totals.visits, totals.domains, totals.active, totals.opportunities) == (0, 13, 0, 0)
    assert totals.delta is None and totals.median_position == 0 and totals.trend_days == 0
    assert not totals.internal_measured
    assert report.signals().count() == 0
    rows = report.site_rows.collect()
    assert len(rows) == 13 and all(r.delta is None and r.visits == 0 for r in rows)


def test_domain_filter(spark):
    report = replace(make(spark), domain=X.SMALL)
    totals = report.totals.first()
    assert (totals.visits, totals.domains, totals.zone_domains) == (40, 1, 0)


def test_report_of_several_dates_equals_single_reports(spark):
    periods = [R.Period(X.day(n)) for n in (7, 8, 9)]
    together = replace(make(spark), periods=periods)
    columns = ["host", "visits", "previous_visits", "bot_visits", "delta", "direct"]
    rows = together.traffic.join(together.sources.select("as_of", "host", "direct"), ["as_of", "host"])
    for period in periods:
        single = replace(make(spark), periods=period)
        alone = single.traffic.join(single.sources.select("host", "direct"), "host")
        part = rows.where(F.col("as_of") == F.lit(period.date))
        assert sorted(map(str, part.select(*columns).collect())) == sorted(
            map(str, alone.select(*columns).collect())
        )


def test_recurrence_over_dates(spark):
    report = replace(make(spark), periods=[R.Period(X.day(n)) for n in range(3, 10)])
    again = H.recurrence(report.signals(["no-comparison"]), escalate_at=1)
    rows = again.where(F.col("host") == X.FLOODED).orderBy("as_of").collect()
    assert [(r.as_of.day, r.recurrence, r.severity) for r in rows] == [(8, 0, 3), (9, 1, 2)]


def test_digest(day_report):
    digest = L.daily_digest(day_report.split, day_report.sites)
    ranked = L.digest_ranked(day_report.split, day_report.sites)
    row = L.digest_body(digest, ranked, H.top_alert(day_report.signals())).first()
    # A zone host has no flood verdict, so its visits are in the digest as they are.
    assert row.human_visits == 17 + 151 + 40 + 1059 and row.bot_visits == 1672
    assert row.body.startswith("1267 visitors (24h)\nfiles.example: 1059\nwiki.example: 151\n")
    assert "🤖 1672 crawler sessions excluded (flooded.example)" in row.body
    assert "❗ files.example error responses" in row.body
    failed = L.digest_body(digest, ranked, H.top_alert(day_report.signals()), False, ("a", "b"))
    assert "\n⚠ no search data: a, b" in failed.first().body


def test_run_result(day_report):
    digest = L.daily_digest(day_report.split, day_report.sites)
    today = R.latest(day_report.tables["traffic"], day_report.periods)
    alert = H.top_alert(day_report.signals(["traffic-drop"]))
    row = L.run_result(today, digest, alert, F.lit(X.LAST), ("zone traffic x: " + "y" * 200,)).first()
    assert row.total_visits == 1689 + 1059 + 151 + 40 and row.search_ok and row.top_kind is None
    assert len(row.notes) == 140


def test_notes_of_panels(spark):
    notes = {r.host: r.note for r in M.panel_notes(make(spark, 7).traffic).collect()}
    assert notes[X.ZONE].endswith(" zone visits · 293.0 GB")
    assert notes[X.FLOODED].startswith(
        "Human figures above cover the 5 clean days, plus 51 referred sessions that survived"
        " the flooded days. A crawler arrives"
    )
    assert notes[X.SMALL] == "Human figures above cover the 2 clean days."
    alone = {r.host: r.note for r in M.panel_notes(make(spark, 1).traffic).collect()}
    assert alone[X.FLOODED].startswith("The figure above is the 17 referred sessions that survived")
    hosts = M.crawler_hosts(make(spark).traffic).collect()
    assert [(h.host, h.bot_visits) for h in hosts] == [(X.FLOODED, 1672)]
    assert hosts[0].share == pytest.approx(1672 / (208 + 1672))


def test_forums(spark):
    from tidegauge import schemas as S

    rows = [(X.day(n), X.FORUM, 100 + n, n, 0, 0, 1, 0, 0, 2, 3, 4) for n in range(-10, 10)]
    activity = R.within(spark.createDataFrame(rows, S.TABLES["forums"]), R.Period(X.LAST))
    report = {r.host: r for r in K.forum_report(X.CONFIG.forums_df(spark), activity).collect()}
    assert report[X.FORUM].active_today == 9 and report[X.FORUM].users_count == 109
    assert report[X.FORUM].mean_active_today == pytest.approx(sum(range(-4, 10)) / 14)
    assert not report["quiet.example"].has_data and report["quiet.example"].users_count == 0


def test_export_is_nested_and_bounded(day_report, tmp_path, spark):
    from tidegauge.sinks.daily import write_report_json

    write_report_json(day_report.export(), str(tmp_path / "report"))
    rows = {r.host: r for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert len(rows) == 13
    assert [p.page for p in rows[X.SUBFLOOD].landing] == ["/wiki/Main_Page", "/sitemap.xml.gz", "/wiki/Other"]
    assert rows[X.ZONE].verified_requests == 3389
    assert len(rows[X.FLOODED].spark) == 14


def rows_without(df, *columns):
    return sorted((tuple(r) for r in df.drop(*columns).collect()), key=str)


def test_several_report_dates_are_several_reports(spark, day_report):
    """Every panel of three dates together is that of three single reports."""

    last = day_report.periods.date
    periods = [R.Period(last - dt.timedelta(n)) for n in (0, 2, 5)]
    together = replace(day_report, periods=periods)
    for name in ("totals", "forums", "digest", "digest_ranked", "coverage", "kinds", "site_rows"):
        got = getattr(together, name)
        for p in periods:
            own = getattr(replace(day_report, periods=p), name)
            mine = got.where(F.col("as_of") == F.lit(p.date)).select(*[c for c in own.columns if c != "as_of"])
            assert rows_without(mine) == rows_without(own, "as_of"), (name, p)


def test_document_has_every_part(spark, day_report):
    rows = day_report.document().collect()
    parts = {r.part for r in rows}
    assert {"totals", "coverage", "traffic_trend", "search_trend", "site", "forum"} <= parts
    sites = [r for r in rows if r.part == "site"]
    assert len(sites) == day_report.sites.count() and all(r.as_of == day_report.periods.date for r in rows)

    places = [json.loads(r.body)["place"] for r in rows if r.part == "signal"]
    assert sorted(places) == list(range(1, len(places) + 1))


def test_result_of_a_run(day_report):
    result = day_report.run_result(["gsc pages a: 403"], ["a"]).first()
    assert (result.date, result.search_ok, result.failed_hosts) == (day_report.periods.date, False, "a")
    assert result.human_visits == day_report.digest.first().human_visits
