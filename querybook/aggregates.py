"""E: crawler floods and zone lenses, F: per-site report, T: totals, O: opportunities."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from querybook.registry import placed, query
from querybook.sql import DATE, OPPORTUNITIES, classified, ctr_case, non_content, site_rows, sql, top
from querybook.views import CONFIG, FLOOD_RULES, LAST, WITH_IDLE
from tidegauge.functions import scalars as D
from tidegauge.operators import floods as E
from tidegauge.operators import opportunities as O
from tidegauge.operators import reads as R
from tidegauge.operators import sites as P
from tidegauge.operators import totals as T
from tidegauge.operators import zone as Z

# ---------------------------------------------------------------------- floods

SHAPE = ("round(pages_per_session, 6) AS pages_per_session, round(direct_share, 6) AS direct_share")


@query("e1_day_shape", sql(
    f"SELECT {DATE}, host, visits, views, bytes, direct, non_direct, {SHAPE}, signature FROM signed", classified()))
def _(v):
    report = v.report()
    return E.day_shape(report.rows("traffic"), report.kinds, FLOOD_RULES).drop("as_of")


@query("e2_flood_baseline", sql("SELECT host, baseline FROM baselines", classified()))
def _(v):
    return v.report().split.groupBy("host").agg(F.max("baseline").alias("baseline"))


@query("e3_classify_floods", sql(
    f"SELECT {DATE}, host, visits, views, bytes, direct, non_direct, {SHAPE}, signature, baseline, flood FROM classified",
    classified()))
def _(v):
    report = v.report()
    return E.classify_floods(report.rows("traffic"), report.kinds, FLOOD_RULES).drop("as_of")


@query("e3_classify_many_dates", sql("""SELECT strftime(as_of, '%Y-%m-%d') AS as_of, strftime(date, '%Y-%m-%d') AS date, host, visits,
  signature, baseline, signature AND visits >= 20 AND visits >= greatest(baseline, 1) * 1.5 AS flood FROM
  (SELECT a.as_of, s.* FROM signed s, (SELECT unnest(range(DATE '2024-01-05', DATE '2024-02-06', INTERVAL 1 DAY))::DATE AS as_of) a
    WHERE s.date BETWEEN a.as_of - 29 AND a.as_of)
  JOIN (SELECT a.as_of, s.host, (CASE WHEN count(*) FILTER (WHERE NOT signature) >= 3
      THEN quantile_disc(visits, 0.5) FILTER (WHERE NOT signature) ELSE quantile_disc(visits, 0.25) END)::BIGINT AS baseline
    FROM signed s, (SELECT unnest(range(DATE '2024-01-05', DATE '2024-02-06', INTERVAL 1 DAY))::DATE AS as_of) a
    WHERE s.date BETWEEN a.as_of - 29 AND a.as_of GROUP BY ALL) USING (as_of, host)""", classified()[:2]))
def _(v):
    """Every report date with its own history and baseline, from one pass over the days."""
    dates = [dt.date(2024, 1, 5) + dt.timedelta(n) for n in range(32)]
    kinds = R.kinds_by_day(v.tables["referrers"])
    found = E.classify_many(v.tables["traffic"], kinds, v.config.sites_df(v.spark), dates, 30, FLOOD_RULES)
    return found.select("as_of", "date", "host", "visits", "signature", "baseline", "flood")


@query("e4_split_day", sql(
    f"SELECT {DATE}, host, human, crawler, human_views, crawler_views, partial FROM split", classified()))
def _(v):
    return v.report().split.select(
        "date", "host", "human", "crawler", "human_views", "crawler_views", "partial"
    )


@query("e5_flood_dates", sql(f"SELECT {DATE}, host FROM floods", classified()))
def _(v):
    return v.report().floods.select("date", "host")


@query("e6_flood_reason", sql(
    f"""SELECT {DATE}, host, round(direct_share * 100)::BIGINT || '% direct, ' || printf('%.1f', pages_per_session)
  || ' pages/session, ' || floor(visits / greatest(baseline, 1) + 0.5)::BIGINT || 'x a normal day' AS reason
  FROM classified WHERE flood""", classified()))
def _(v):
    return v.report().split.where("flood").select("date", "host", E.flood_reason().alias("reason"))


@query("e7_flood_run", sql(
    """SELECT host, count(*) AS flood_run FROM (SELECT host, date, row_number() OVER (PARTITION BY host ORDER BY date DESC) AS n
  FROM floods) WHERE DATE '2024-01-30' - date = n - 1 GROUP BY host""", classified()))
def _(v):
    return E.flood_run(v.report().floods).drop("as_of")


@query("e8_crawler_route", sql(
    "SELECT host, CASE measurement WHEN 'zone' THEN 'zone' ELSE 'flood' END AS route, sum(views)::BIGINT AS views"
    " FROM sites JOIN traffic USING (host) GROUP BY ALL"))
def _(v):
    joined = v.tables["traffic"].join(CONFIG.sites_df(v.spark), "host")
    return joined.groupBy("host", Z.crawler_route(F.col("measurement")).alias("route")).agg(
        F.sum("views").alias("views")
    )


VERIFIED = "category <> '(unverified)'"


@query("e9_verified_bots", sql(f"""SELECT s.host, coalesce(vr, 0) AS verified_requests, coalesce(vv, 0) AS verified_visits,
  coalesce(ur, 0) AS unverified_requests, coalesce(uv, 0) AS unverified_visits, coalesce(vr + ur, 0) AS total_requests,
  coalesce(vv + uv, 0) AS total_visits, round(coalesce(vr / (vr + ur), 0), 6) AS verified_share, vr IS NOT NULL AS measured
  FROM sites s LEFT JOIN (SELECT host, coalesce(sum(requests) FILTER (WHERE {VERIFIED}), 0)::BIGINT AS vr,
    coalesce(sum(visits) FILTER (WHERE {VERIFIED}), 0)::BIGINT AS vv,
    coalesce(sum(requests) FILTER (WHERE NOT {VERIFIED}), 0)::BIGINT AS ur,
    coalesce(sum(visits) FILTER (WHERE NOT {VERIFIED}), 0)::BIGINT AS uv
    FROM zone_bots WHERE date = DATE '2024-01-30' GROUP BY host) b USING (host)"""))
def _(v):
    report = v.report()
    bots = report.rows("zone_bots", "date")
    return Z.verified_bots(bots, report.sites.drop("measurement")).drop("as_of")


@query("e9_verified_categories", sql(
    f"SELECT host, category, requests, visits FROM zone_bots WHERE date = DATE '2024-01-30' AND {VERIFIED}"))
def _(v):
    return Z.verified_categories(v.report().rows("zone_bots", "date")).drop("as_of")


@query("e10_non_content_paths", sql(
    f"SELECT host, page, sum(requests)::BIGINT AS requests FROM zone_pages WHERE date = DATE '2024-01-30'"
    f" AND {non_content('page')} GROUP BY ALL"))
def _(v):
    return Z.non_content_paths(v.report().rows("zone_pages", "date")).drop("as_of")


@query("e10_error_statuses", sql(
    "SELECT host, status, sum(requests)::BIGINT AS requests FROM zone_status WHERE date = DATE '2024-01-30'"
    " AND status >= 400 GROUP BY ALL"))
def _(v):
    return Z.error_statuses(v.report().rows("zone_status", "date")).drop("as_of")


@query("e10_non_content_totals", sql(f"""SELECT host, sum(p)::BIGINT AS path_requests, sum(e)::BIGINT AS error_requests FROM (
  SELECT host, requests AS p, 0 AS e FROM zone_pages WHERE date = DATE '2024-01-30' AND {non_content('page')}
  UNION ALL SELECT host, 0, requests FROM zone_status WHERE date = DATE '2024-01-30' AND status >= 400) GROUP BY host"""))
def _(v):
    report = v.report()
    pages, statuses = report.rows("zone_pages", "date"), report.rows("zone_status", "date")
    return Z.non_content_totals(pages, statuses).drop("as_of")


# ------------------------------------------------------------- per-site report

for _days in (1, 7, 30):

    @query(f"f1_site_traffic_{_days}d", sql("SELECT * FROM st", classified(), site_rows(_days)))
    def _(v, days=_days):
        report = v.report(days)
        measured = P.site_traffic(report.split, days)
        names = [c for c in measured.columns if c not in ("as_of", "host")]
        return report.sites.join(measured, ["as_of", "host"], "left").fillna(0, names).drop("as_of")


@query("f2_merge_landing", sql("SELECT host, page, visits, views FROM land", classified(), site_rows(7)))
def _(v):
    return v.report(7).landing.drop("as_of")


@query("f2_merge_referrers", sql("SELECT host, referrer, kind, visits FROM refs", classified(), site_rows(30)))
def _(v):
    return v.report(30).referrers.drop("as_of")


@query("f3_site_sources", sql("SELECT * FROM sources", classified(), site_rows(7)))
def _(v):
    return v.report(7).sources.drop("as_of")


@query("f4_site_delta", sql(
    "SELECT host, visits, previous_visits, round(delta, 6) AS delta FROM sr", classified(), site_rows(7)))
def _(v):
    return v.report(7).traffic.select("host", "visits", "previous_visits", "delta")


@query("f5_pages_per_session", sql(
    "SELECT host, round(pages_per_session, 6) AS pages_per_session,"
    " round(previous_pages_per_session, 6) AS previous_pages_per_session,"
    " round(pages_per_session_delta, 6) AS pages_per_session_delta FROM sr", classified(), site_rows(7)))
def _(v):
    return v.report(7).traffic.select(
        "host", "pages_per_session", "previous_pages_per_session", "pages_per_session_delta"
    )


@query("f6_latest_anomaly", sql(
    """SELECT host, arg_max(round(direct_share * 100)::BIGINT || '% direct, ' || printf('%.1f', pages_per_session)
  || ' pages/session, ' || floor(visits / greatest(baseline, 1) + 0.5)::BIGINT || 'x a normal day', date) AS anomaly
  FROM classified WHERE flood GROUP BY host""", classified()))
def _(v):
    return P.latest_anomaly(v.report().split).drop("as_of")


@query("f7_top_referrers_card", sql(
    "SELECT host, referrer, kind, visits, rank FROM refs_card", classified(), site_rows(7)))
def _(v):
    return P.referrer_card(v.report(7).referrers).drop("as_of")


KEYWORD_ORDER = "clicks DESC, impressions DESC, query"
RECOMPUTED_CTR = "round(CASE WHEN impressions <> 0 THEN clicks / impressions ELSE 0 END, 6) AS ctr"


@query("f8_top_keywords_card", sql(
    f"SELECT host, query, clicks, impressions, position, {RECOMPUTED_CTR}, rank FROM "
    + top("keywords", "host", KEYWORD_ORDER, 12)))
def _(v):
    card = P.keyword_card(v.report().keywords)
    return card.select("host", "query", "clicks", "impressions", "position", "ctr", "rank")


@query("f9_top_search_pages_card", sql(
    "SELECT host, page, clicks, impressions, round(ctr, 6) AS ctr, round(position, 6) AS position, rank FROM "
    + top("search_pages", "host", "clicks DESC, impressions DESC, page", 8)))
def _(v):
    card = P.search_page_card(v.report().search_pages)
    return card.select("host", "page", "clicks", "impressions", "ctr", "position", "rank")


@query("f10_top_landing_card", sql(
    "SELECT host, page, visits, views, rank FROM land_card", classified(), site_rows(7)))
def _(v):
    return v.report(7).landing_card.drop("as_of")


@query("f10_top_files_card", sql(
    "SELECT host, page, requests, zone_visits, rank FROM " + top(
        "(SELECT host, page, sum(requests)::BIGINT AS requests, sum(zone_visits)::BIGINT AS zone_visits"
        " FROM zone_pages WHERE date > DATE '2024-01-23' GROUP BY ALL)", "host", "requests DESC, page", 8)))
def _(v):
    return P.file_card(v.report(7).rows("zone_pages", "start")).drop("as_of")


@query("f11_site_search_summary", sql(
    "SELECT s.host, clicks, impressions, round(ctr, 6) AS ctr, position, q.host IS NOT NULL AS has_search"
    " FROM (SELECT host FROM sites UNION ALL SELECT 'idle.example') s"
    " LEFT JOIN (SELECT * FROM search_summary WHERE date = DATE '2024-01-30') q USING (host)"))
def _(v):
    report = replace(v.report(), config=WITH_IDLE)
    return P.site_search_summary(report.sites, report.search_latest).drop("as_of")


@query("f12_site_bytes", sql("SELECT host, bytes FROM st", classified(), site_rows(30)))
def _(v):
    return v.report(30).traffic.select("host", "bytes")


@query("f13_zone_country_card", sql(
    "SELECT host, country, visits, rank FROM " + top(
        "(SELECT * FROM zone_countries WHERE date = DATE '2024-01-30')", "host", "visits DESC, country", 10)))
def _(v):
    card = P.country_card(v.report().rows("zone_countries", "date"))
    return card.select("host", "country", "visits", "rank")


@query("f13_zone_status_card", sql(
    "SELECT host, status, requests, rank FROM " + top(
        "(SELECT * FROM zone_status WHERE date = DATE '2024-01-30')", "host", "requests DESC, status", 8)))
def _(v):
    card = P.status_card(v.report().rows("zone_status", "date"))
    return card.select("host", "status", "requests", "rank")


@query("f14_sparkline", sql(
    f"SELECT {DATE}, host, visits, flood FROM " + top("classified", "host", "date DESC", 14), classified()))
def _(v):
    return P.sparkline(v.report().split).drop("as_of")


@query("f15_site_window_label", sql(
    """SELECT host, coalesce(max(w) FILTER (WHERE s = 1), max(w) FILTER (WHERE s = 2), max(w) FILTER (WHERE s = 3)) AS search_window
  FROM (SELECT host, 1 AS s, search_window AS w FROM search_summary WHERE date = DATE '2024-01-30'
  UNION ALL SELECT host, 2, search_window FROM keywords UNION ALL SELECT host, 3, search_window FROM search_pages
  UNION ALL SELECT 'idle.example', 2, search_window FROM keywords WHERE host = 'site0.example') GROUP BY host"""))
def _(v):
    report = v.report()
    # A site that has no summary row is labelled by its keywords.
    idle = report.keywords.where(F.col("host") == "site0.example").withColumn("host", F.lit("idle.example"))
    return P.window_label(report.search_latest, report.keywords.unionByName(idle), report.search_pages).drop("as_of")


for _sort, _by in {
    "traffic": "visits DESC, host", "change": "delta DESC NULLS LAST, host", "name": "host",
}.items():

    @query(f"f16_site_order_{_sort}", sql(
        f"SELECT host, measurement, visits, round(delta, 6) AS delta, row_number() OVER (ORDER BY measurement <> 'rum', {_by}) AS place FROM sr",
        classified(), site_rows(7)))
    def _(v, sort=_sort):
        columns = ["host", "measurement", "visits", "delta"]
        return placed(P.site_order(v.report(7).traffic.select(*columns), sort))


OPP_COUNTS = """counts AS (SELECT host, count(*) FILTER (WHERE kind = 'snippet') AS snippet_count,
  count(*) FILTER (WHERE kind = 'rank') AS rank_count FROM opps GROUP BY host)"""


for _days in (1, 7):

    @query(f"f17_site_report_{_days}d", sql("""SELECT sr.host, sr.measurement, visits, views, previous_visits, bot_visits, bot_days,
  partial_visits, partial_days, previous_partial_days, clean_days, sr.bytes, round(delta, 6) AS delta,
  round(pages_per_session, 6) AS pages_per_session, direct, search, social, referral, internal, unattributed,
  coalesce(snippet_count, 0) AS snippet_count, coalesce(rank_count, 0) AS rank_count,
  coalesce(snippet_count + rank_count, 0) AS opportunity_count, q.clicks AS search_clicks,
  q.impressions AS search_impressions, q.position AS search_position, q.search_window
  FROM sr JOIN sources USING (host) LEFT JOIN counts USING (host)
  LEFT JOIN (SELECT * FROM search_summary WHERE date = DATE '2024-01-30') q USING (host)""",
        classified(), site_rows(_days), OPPORTUNITIES, [OPP_COUNTS]))
    def _(v, days=_days):
        rows = v.full_report(days).site_rows
        return rows.select(
            "host", "measurement", "visits", "views", "previous_visits", "bot_visits", "bot_days",
            "partial_visits", "partial_days", "previous_partial_days", "clean_days", "bytes", "delta",
            "pages_per_session", "direct", "search", "social", "referral", "internal", "unattributed",
            "snippet_count", "rank_count", "opportunity_count", "search_clicks", "search_impressions",
            "search_position", "search_window",
        )


# ----------------------------------------------------------------------- totals


@query("t1_rum_totals", sql("""SELECT sum(visits)::BIGINT AS visits, sum(views)::BIGINT AS views,
  sum(previous_visits)::BIGINT AS previous_visits, sum(bot_visits)::BIGINT AS bot_visits, sum(bot_views)::BIGINT AS bot_views,
  sum(previous_bot_visits)::BIGINT AS previous_bot_visits, sum(partial_visits)::BIGINT AS partial_visits,
  count(*) FILTER (WHERE partial_days > 0) AS partial_sites, sum(bot_days)::BIGINT AS flooded_site_days,
  count(*) FILTER (WHERE bot_days > 0) AS flooded_sites FROM st WHERE measurement = 'rum'""", classified(), site_rows(7)))
def _(v):
    return T.rum_totals(v.report(7).traffic)


@query("t2_zone_totals", sql("""SELECT sum(visits)::BIGINT AS visits, sum(views)::BIGINT AS requests, sum(bytes)::BIGINT AS bytes,
  count(*) AS sites, string_agg(host, ',' ORDER BY host) AS hosts FROM st WHERE measurement = 'zone'""", classified(), site_rows(7)))
def _(v):
    return T.zone_totals(v.report(7).traffic)


@query("t3_source_mix", sql("""SELECT sum(direct)::BIGINT AS direct, sum(search)::BIGINT AS search, sum(social)::BIGINT AS social,
  sum(referral)::BIGINT AS referral, sum(internal)::BIGINT AS internal, sum(unattributed)::BIGINT AS unattributed
  FROM sources WHERE measurement = 'rum'""", classified(), site_rows(7)))
def _(v):
    return T.source_mix(v.report(7).sources)


@query("t4_internal_measured", sql(
    "SELECT count(*) > 0 AS internal_measured FROM referrers WHERE kind = 'internal' AND date > DATE '2024-01-23'"
    " AND host IN (SELECT host FROM sites WHERE measurement = 'rum')"))
def _(v):
    report = v.report(7)
    return T.internal_measured(report.period_referrers, report.sites)


@query("t5_site_counts", sql("""SELECT count(*) AS domains, count(*) FILTER (WHERE measurement = 'rum') AS rum_domains,
  count(*) FILTER (WHERE measurement = 'zone') AS zone_domains, count(*) FILTER (WHERE visits > 0) AS active FROM st""",
    classified(), site_rows(1)))
def _(v):
    return T.site_counts(v.report().traffic)


TOTAL_RATIOS = """SELECT round((v - p) / p, 6) AS delta, round(w / v, 6) AS pages_per_session, round(s / v, 6) AS search_share,
  round(b / (v + b), 6) AS bot_share, round(c / i, 6) AS search_ctr FROM
  (SELECT sum(visits) AS v, sum(views) AS w, sum(previous_visits) AS p, sum(bot_visits) AS b FROM st WHERE measurement = 'rum'),
  (SELECT sum(search) AS s FROM sources WHERE measurement = 'rum'),
  (SELECT sum(clicks) AS c, sum(impressions) AS i FROM search_summary WHERE date = DATE '2024-01-30')"""


@query("t6_ratios", sql(TOTAL_RATIOS, classified(), site_rows(7)))
def _(v):
    report = v.report(7)
    one = F.lit(1).alias("one")
    row = (
        T.rum_totals(report.traffic).select("*", one)
        .join(T.source_mix(report.sources).select("search", one), "one")
        .join(T.search_totals(report.search_latest).select("clicks", "impressions", one), "one")
    )
    return T.with_ratios(row).select(
        "delta", "pages_per_session", "search_share", "bot_share", "search_ctr"
    )


SEARCH_LATEST = "FROM search_summary WHERE date = DATE '2024-01-30'"


@query("t7_weighted_position", sql(
    f"SELECT round(sum(position * impressions) / sum(impressions), 6) AS weighted_position {SEARCH_LATEST}"))
def _(v):
    return T.search_totals(v.report().search_latest).select("weighted_position")


@query("t8_search_totals", sql(
    f"SELECT sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, count(*) AS search_domains {SEARCH_LATEST}"))
def _(v):
    return T.search_totals(v.report().search_latest).drop("weighted_position")


@query("t9_median_position", sql(
    "SELECT count(*) AS position_queries, count(*) FILTER (WHERE position <= 10) AS top10_queries,"
    " round(median(position), 6) AS median_position FROM keywords WHERE position > 0 AND impressions >= 10"))
def _(v):
    return T.median_position(v.report().keywords)


@query("t10_expected_ctr_mix", sql(f"""SELECT round(e / i, 6) AS expected_ctr, round(c / i, 6) AS sample_ctr, c AS sample_clicks,
  i AS sample_impressions, n AS sample_queries, round(i / corpus, 6) AS sample_share,
  i / corpus > 0 AND i / corpus < 0.25 AS thin_sample FROM
  (SELECT sum(impressions * ({ctr_case('position')})) AS e, sum(impressions)::BIGINT AS i, sum(clicks)::BIGINT AS c, count(*) AS n
   FROM keywords WHERE position > 0), (SELECT sum(impressions) AS corpus {SEARCH_LATEST})"""))
def _(v):
    report = v.report()
    return T.expected_ctr_mix(report.keywords, report.search_latest)


TREND = """trend AS (SELECT d.date, d.visits, d.views, coalesce(s.visits, 0) AS search FROM
  (SELECT date, sum(human) AS visits, sum(human_views) AS views FROM split WHERE host <> 'files.example' GROUP BY date) d
  LEFT JOIN (SELECT date, sum(visits) AS visits FROM kinds WHERE kind = 'search' GROUP BY date) s USING (date)
  ORDER BY d.date DESC LIMIT 14)"""


@query("t11_traffic_trend", sql(
    "SELECT count(*) AS trend_days, round(avg(visits), 6) AS visits_per_day, round(avg(views), 6) AS views_per_day,"
    " round(avg(search), 6) AS search_per_day FROM trend", classified(), [TREND]))
def _(v):
    report = v.report()
    return T.traffic_comparator(T.traffic_trend(report.split, report.kinds, report.sites))


SNAPSHOTS = """snaps AS (SELECT date, sum(clicks) AS clicks, sum(impressions) AS impressions, max(search_window) AS search_window
  FROM search_summary GROUP BY date ORDER BY date DESC LIMIT 14)"""


@query("t12_search_trend", sql(
    "SELECT count(*) AS snapshots, round(avg(clicks), 6) AS clicks_per_snapshot, round(avg(impressions), 6) AS impressions_per_snapshot,"
    " round(sum(clicks) / sum(impressions), 6) AS trend_ctr, arg_min(search_window, date) AS window_first,"
    " arg_max(search_window, date) AS window_last FROM snaps", [SNAPSHOTS]))
def _(v):
    return T.search_comparator(T.search_trend(v.report().search_history))


@query("t12_search_series", sql(
    f"SELECT {DATE}, clicks::BIGINT AS clicks, impressions::BIGINT AS impressions, search_window FROM snaps", [SNAPSHOTS]))
def _(v):
    return T.last_dates(T.search_trend(v.report().search_history))


@query("t13_opportunity_totals", sql(
    "SELECT count(*) AS opportunities, count(*) FILTER (WHERE kind = 'snippet') AS snippet,"
    " count(*) FILTER (WHERE kind = 'rank') AS rank FROM opps", OPPORTUNITIES))
def _(v):
    return O.opportunity_totals(v.report().opportunities)


@query("t14_headline_opportunity_site", sql(
    """SELECT host, round(s, 6) AS score FROM (SELECT host, coalesce(max(score) FILTER (WHERE kind = 'snippet'),
  max(score) FILTER (WHERE kind = 'rank')) AS s FROM opps GROUP BY host) ORDER BY s DESC, host LIMIT 1""", OPPORTUNITIES))
def _(v):
    return O.headline_site(v.report().opportunity_facts)


@query("t15_per_day_rate", sql(
    """SELECT host, CASE WHEN n > 0 THEN floor(visits / n + 0.5)::BIGINT END AS per_day, NULL::BIGINT AS single FROM st,
  (SELECT count(DISTINCT date) AS n FROM traffic WHERE date > DATE '2024-01-23')""", classified(), site_rows(7)))
def _(v):
    dates = R.dates_available(v.tables["traffic"], R.Period(LAST, 7)).select("days_available", F.lit(1).alias("one"))
    rows = v.report(7).traffic.withColumn("one", F.lit(1)).join(dates, "one")
    days = F.col("days_available")
    return rows.select(
        "host", T.per_day_rate(F.col("visits"), days, 7).alias("per_day"),
        T.per_day_rate(F.col("visits"), days, 1).alias("single"),
    )


@query("t16_thin_sample", sql(
    """SELECT host, round(sample / corpus, 6) AS share, sample > 0 AND sample / corpus < 0.25 AS thin FROM
  (SELECT host, sum(impressions) AS sample FROM keywords GROUP BY host) JOIN
  (SELECT host, impressions AS corpus FROM search_summary WHERE date = DATE '2024-01-30') USING (host) WHERE corpus > 0"""))
def _(v):
    report = v.report()
    sample = report.keywords.groupBy("host").agg(F.sum("impressions").alias("sample"))
    corpus = report.search_latest.select("host", F.col("impressions").alias("corpus")).where("corpus > 0")
    share = D.ratio(F.col("sample"), F.col("corpus"))
    return sample.join(corpus, "host").select("host", share.alias("share"), T.thin_sample(share).alias("thin"))


@query("t17_staleness_and_coverage", sql(
    """SELECT host, epoch(TIMESTAMP '2024-01-31 06:00:00') - epoch(max(ts)) > 30 * 3600 AS stale,
  CASE WHEN count(DISTINCT date) < 30 THEN count(DISTINCT date) || ' of 30 daily snapshots available' END AS note
  FROM rum GROUP BY host"""))
def _(v):
    now = F.lit("2024-01-31 06:00:00").cast("timestamp")
    rows = v.rum.groupBy("host").agg(
        F.max("ts").cast("timestamp").alias("updated"), F.countDistinct("date").alias("n")
    )
    return rows.select(
        "host", T.is_stale(F.col("updated"), now).alias("stale"), T.coverage_note("n", 30).alias("note")
    )


@query("t18_top_opportunities", sql(
    "SELECT kind, host, query, round(score, 6) AS score, rank FROM "
    + top("opps", "kind", "score DESC, host, query", 5), OPPORTUNITIES))
def _(v):
    top_rows = O.top_opportunities(v.report().opportunities)
    return top_rows.select("kind", "host", "query", "score", "rank")


@query("t_report_totals", sql("""SELECT visits, bot_visits, zone_requests, domains, direct, snippet_opportunities, rank_opportunities,
  position_queries, trend_days, snapshots FROM
  (SELECT sum(visits)::BIGINT AS visits, sum(bot_visits)::BIGINT AS bot_visits FROM st WHERE measurement = 'rum'),
  (SELECT sum(views)::BIGINT AS zone_requests FROM st WHERE measurement = 'zone'), (SELECT count(*) AS domains FROM st),
  (SELECT sum(direct)::BIGINT AS direct FROM sources WHERE measurement = 'rum'),
  (SELECT count(*) FILTER (WHERE kind = 'snippet') AS snippet_opportunities,
     count(*) FILTER (WHERE kind = 'rank') AS rank_opportunities FROM opps),
  (SELECT count(*) AS position_queries FROM keywords WHERE position > 0 AND impressions >= 10),
  (SELECT count(*) AS trend_days FROM trend), (SELECT count(*) AS snapshots FROM snaps)""",
    classified(), site_rows(7), OPPORTUNITIES, [TREND, SNAPSHOTS]))
def _(v):
    totals = v.full_report(7).totals
    return totals.select(
        "visits", "bot_visits", "zone_requests", "domains", "direct", "snippet_opportunities",
        "rank_opportunities", "position_queries", "trend_days", "snapshots",
    )


DOCUMENT = {
    "totals": "NULL AS host, sum(visits)::BIGINT || '' AS item FROM st WHERE measurement = 'rum'",
    "traffic_trend": "NULL, strftime(date, '%Y-%m-%d') || '|' || visits || '|' || views || '|' || search FROM (SELECT * FROM trend ORDER BY date DESC LIMIT 14)",
    "search_trend": "NULL, strftime(date, '%Y-%m-%d') || '|' || clicks || '|' || impressions FROM (SELECT * FROM snaps ORDER BY date DESC LIMIT 14)",
    "site": "host, visits || '|' || views || '|' || bot_visits FROM sr",
    "opportunity": "host, kind || '|' || query || '|' || clicks || '|' || impressions FROM opps",
    "verified_category": "host, category || '|' || requests || '|' || visits FROM zone_bots"
                         " WHERE date = DATE '2024-01-30' AND category NOT IN ('', '(unverified)')",
}
FIELDS = {
    "totals": ["visits"], "traffic_trend": ["date", "visits", "views", "search"], "search_trend": ["date", "clicks", "impressions"],
    "site": ["visits", "views", "bot_visits"], "opportunity": ["kind", "query", "clicks", "impressions"],
    "verified_category": ["category", "requests", "visits"],
}


@query("s5_report_document", sql(" UNION ALL ".join(f"SELECT '{part}' AS part, {body}" for part, body in DOCUMENT.items()),
    classified(), site_rows(7), OPPORTUNITIES, [TREND, SNAPSHOTS]))
def _(v):
    """Entries of six parts of the whole report's document, read back from their JSON."""
    found = v.full_report(7).document()
    item = F.lit(None).cast("string")
    for part, fields in FIELDS.items():
        item = F.when(F.col("part") == part, F.concat_ws("|", *[F.get_json_object("body", f"$.{f}") for f in fields])).otherwise(item)
    return found.where(F.col("part").isin(list(FIELDS))).select("part", "host", item.alias("item"))


# ---------------------------------------------------------------- opportunities

OPP = ("host, query, clicks, impressions, position, round(ctr, 6) AS ctr, round(expected_ctr, 6) AS expected_ctr, kind,"
       " round(lost_clicks, 6) AS lost_clicks, round(potential_clicks, 6) AS potential_clicks, round(score, 6) AS score")
OPP_COLUMNS = ["host", "query", "clicks", "impressions", "position", "ctr", "expected_ctr", "kind",
               "lost_clicks", "potential_clicks", "score"]


@query("o1_classify_opportunity", sql(f"SELECT {OPP} FROM opps", OPPORTUNITIES))
def _(v):
    return v.report().opportunities.select(*OPP_COLUMNS)


@query("o2_rank_opportunities", sql("SELECT host, kind, query, round(score, 6) AS score FROM opps", OPPORTUNITIES))
def _(v):
    return O.rank_opportunities(v.report().opportunities).select("host", "kind", "query", "score")


@query("o2_opportunity_facts", sql("""SELECT host, count(*) FILTER (WHERE kind = 'snippet') AS snippet_count,
  count(*) FILTER (WHERE kind = 'rank') AS rank_count, round(sum(score) FILTER (WHERE kind = 'snippet'), 4) AS snippet_clicks,
  round(sum(score) FILTER (WHERE kind = 'rank'), 4) AS rank_clicks, max(query) FILTER (WHERE kind = 'snippet' AND n = 1) AS snippet_lead,
  max(query) FILTER (WHERE kind = 'rank' AND n = 1) AS rank_lead FROM
  (SELECT *, row_number() OVER (PARTITION BY host, kind ORDER BY score DESC, query) AS n FROM opps) GROUP BY host""", OPPORTUNITIES))
def _(v):
    facts = v.report().opportunity_facts
    return facts.select(
        "host", "snippet_count", "rank_count", F.round("snippet_clicks", 4).alias("snippet_clicks"),
        F.round("rank_clicks", 4).alias("rank_clicks"), F.col("snippet_lead.query").alias("snippet_lead"),
        F.col("rank_lead.query").alias("rank_lead"),
    )


@query("o3_opportunity_flag", sql(
    "SELECT k.host, k.query, o.query IS NOT NULL AS is_opportunity, o.kind FROM keywords k LEFT JOIN opps o USING (host, query)",
    OPPORTUNITIES))
def _(v):
    report = v.report()
    classified_rows = O.classify_keywords(report.keywords, CONFIG.deny(v.spark))
    flagged = O.flag_keywords(classified_rows)
    return flagged.select("host", "query", "is_opportunity", "kind")
