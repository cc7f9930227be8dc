"""B: ingest transforms, S: sinks, R: report reads, J and N: joins."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querybook.registry import placed, query
from querybook.sql import DATE, WINDOW, classified, non_content, site_rows, sql, top
from querybook.sources import land_zone
from querybook.views import CONFIG, LAST
from tidegauge.functions.scalars import search_window
from tidegauge.operators import audit as N
from tidegauge.operators import floods as E
from tidegauge.operators import ingest as B
from tidegauge.operators import opportunities as O
from tidegauge.operators import reads as R
from tidegauge.operators import signals as H
from tidegauge.operators import totals as T
from tidegauge.sinks import daily
from tidegauge.sinks.scratch import new_folder
from tidegauge.sources import landed as A
from tidegauge.sources.tables import read_table


@query("b1_alias_rollup", sql(f"SELECT event_id, {DATE}, host, raw_host, path FROM rum"))
def _(v):
    known = B.resolve_hosts(v.beacons, CONFIG.aliases_df(v.spark))
    return known.select("event_id", "date", "host", "raw_host", "path")


@query("b1_unknown_hosts_dropped", sql(
    "SELECT count(*) AS rows_in, count(*) FILTER (WHERE host = 'site1.example') AS rows_kept FROM rum"))
def _(v):
    only = CONFIG.aliases_df(v.spark).where(F.col("host") == "site1.example")
    kept = B.resolve_hosts(v.beacons, only)
    both = v.beacons.select(F.lit(0).alias("kept")).unionByName(kept.select(F.lit(1).alias("kept")))
    return both.agg(
        F.count_if(F.col("kept") == 0).alias("rows_in"), F.count_if(F.col("kept") == 1).alias("rows_kept")
    )


@query("b2_exclude_paths", sql(
    f"SELECT event_id, {DATE}, host, path FROM rum WHERE NOT (host = 'site2.example' AND path = '/p/3')"))
def _(v):
    return v.counted.select("event_id", "date", "host", "path")


COUNTED = "counted AS (SELECT * FROM rum WHERE NOT (host = 'site2.example' AND path = '/p/3'))"


@query("b3_host_totals", sql(
    f"SELECT {DATE}, host, sum(visits)::BIGINT AS visits, sum(views)::BIGINT AS views FROM counted GROUP BY ALL",
    [COUNTED]))
def _(v):
    return B.host_daily_traffic(v.counted)


REFERRER = "CASE WHEN referer = '' THEN '(direct)' ELSE referer END"


@query("b4_referrer_rollup", sql(
    f"SELECT {DATE}, host, {REFERRER} AS referrer, sum(visits)::BIGINT AS visits FROM counted"
    " WHERE visits > 0 GROUP BY ALL", [COUNTED]))
def _(v):
    return B.referrer_daily(v.counted)


@query("b5_landing_rollup", sql(
    f"SELECT {DATE}, host, path AS page, sum(visits)::BIGINT AS visits, sum(views)::BIGINT AS views"
    " FROM counted GROUP BY ALL", [COUNTED]))
def _(v):
    return B.landing_daily(v.counted)


@query("b5_beacon_rollup_one_pass", sql(f"""SELECT 'referrers' AS section, {DATE}, host, {REFERRER} AS referrer, NULL AS page,
    sum(visits)::BIGINT AS visits, sum(views)::BIGINT AS views FROM counted GROUP BY date, host, referer HAVING sum(visits) > 0
  UNION ALL SELECT 'landing', strftime(date, '%Y-%m-%d'), host, NULL, path, sum(visits)::BIGINT, sum(views)::BIGINT
    FROM counted GROUP BY date, host, path""", [COUNTED]))
def _(v):
    return B.beacon_rollup(v.counted)


@query("b3_host_totals_from_rollup", sql(
    f"SELECT {DATE}, host, sum(visits)::BIGINT AS visits, sum(views)::BIGINT AS views FROM counted GROUP BY ALL",
    [COUNTED]))
def _(v):
    return B.beacon_traffic(B.beacon_rollup(v.counted))


@query("b6_zone_rollup", sql("""SELECT section, strftime(date, '%Y-%m-%d') AS date, host, page, country, status, category, requests, visits, bytes FROM (
  SELECT 'zone_pages' AS section, date, host, path AS page, NULL AS country, NULL::BIGINT AS status, NULL AS category,
    sum(requests)::BIGINT AS requests, sum(visits)::BIGINT AS visits, sum(bytes)::BIGINT AS bytes FROM zone_log GROUP BY date, host, path
  UNION ALL SELECT 'zone_countries', date, host, NULL, coalesce(nullif(country, ''), 'Unknown'), NULL, NULL, sum(requests)::BIGINT,
    sum(visits)::BIGINT, sum(bytes)::BIGINT FROM zone_log GROUP BY date, host, country
  UNION ALL SELECT 'zone_status', date, host, NULL, NULL, status, NULL, sum(requests)::BIGINT, sum(visits)::BIGINT, sum(bytes)::BIGINT
    FROM zone_log GROUP BY date, host, status
  UNION ALL SELECT 'zone_bots', date, host, NULL, NULL, NULL, coalesce(nullif(category, ''), '(unverified)'), sum(requests)::BIGINT,
    sum(visits)::BIGINT, sum(bytes)::BIGINT FROM zone_log GROUP BY date, host, category)"""))
def _(v):
    return v.zone_rollup


@query("b6_zone_totals", sql(f"SELECT {DATE}, host, visits, views, bytes FROM zone_daily"))
def _(v):
    return B.zone_traffic(v.zone_rollup)


@query("b6_zone_rollup_from_responses", sql(f"""SELECT section, {DATE}, host, page, country, status, category, requests, visits, bytes FROM (
  SELECT 'zone_total' AS section, date, host, NULL AS page, NULL AS country, NULL::BIGINT AS status, NULL AS category,
    views AS requests, visits, bytes FROM zone_daily
  UNION ALL SELECT 'zone_pages', date, host, path, NULL, NULL, NULL, sum(requests)::BIGINT, sum(visits)::BIGINT, sum(bytes)::BIGINT
    FROM zone_log GROUP BY date, host, path
  UNION ALL SELECT 'zone_countries', date, host, NULL, coalesce(nullif(country, ''), 'Unknown'), NULL, NULL, sum(requests)::BIGINT,
    sum(visits)::BIGINT, sum(bytes)::BIGINT FROM zone_log GROUP BY date, host, country
  UNION ALL SELECT 'zone_status', date, host, NULL, NULL, status, NULL, sum(requests)::BIGINT, sum(visits)::BIGINT, sum(bytes)::BIGINT
    FROM zone_log GROUP BY date, host, status
  UNION ALL SELECT 'zone_bots', date, host, NULL, NULL, NULL, coalesce(nullif(category, ''), '(unverified)'), sum(requests)::BIGINT,
    sum(visits)::BIGINT, sum(bytes)::BIGINT FROM zone_log GROUP BY date, host, category)"""))
def _(v):
    return B.zone_rollup_from_groups(A.read_zone(v.spark, land_zone(v)))


@query("b6_zone_totals_from_responses", sql(f"SELECT {DATE}, host, visits, views, bytes FROM zone_daily"))
def _(v):
    return B.zone_traffic(B.zone_rollup_from_groups(A.read_zone(v.spark, land_zone(v))))


@query("b7_zone_top_paths", sql(
    f"SELECT {DATE}, host, page, requests, zone_visits, rank FROM "
    + top("zone_paths", "date, host", "requests DESC, page", 20)))
def _(v):
    return B.zone_top_paths(v.zone_rollup, 20)


@query("b8_zone_top_countries", sql(
    f"SELECT {DATE}, host, country, visits, rank FROM "
    + top("zone_countries", "date, host", "visits DESC, country", 10)))
def _(v):
    return B.zone_top_countries(v.zone_rollup)


@query("b9_zone_top_statuses", sql(
    f"SELECT {DATE}, host, status, requests, rank FROM "
    + top("zone_status", "date, host", "requests DESC, status", 3)))
def _(v):
    return B.zone_top_statuses(v.zone_rollup, 3)


@query("b10_zone_bot_rows", sql(f"SELECT {DATE}, host, category, requests, visits FROM zone_bots"))
def _(v):
    return B.zone_bot_rows(v.zone_rollup)




@query("b11_top_referrers", sql(
    f"SELECT {DATE}, host, referrer, kind, visits, rank FROM "
    + top("referrers", "date, host", "visits DESC, referrer", 4)))
def _(v):
    return B.top_referrers(B.referrer_daily(v.rum), 4, CONFIG.aliases_df(v.spark))


@query("b12_top_pages", sql(
    f"SELECT {DATE}, host, page, visits, views, rank FROM "
    + top("landing", "date, host", "visits DESC, page", 8)))
def _(v):
    return B.top_pages(B.landing_daily(v.rum))


@query("b13_zero_fill_sites", sql("""SELECT strftime(d::DATE, '%Y-%m-%d') AS date, s.host, coalesce(visits, 0) AS visits,
  coalesce(views, 0) AS views FROM sites s CROSS JOIN generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) g(d)
  LEFT JOIN rum_daily r ON r.host = s.host AND r.date = d::DATE"""))
def _(v):
    return B.fill_sites(
        B.host_daily_traffic(v.rum), CONFIG.sites_df(v.spark), "2024-01-01", "2024-01-31"
    )


@query("b14_search_window", sql(f"SELECT DISTINCT {DATE}, {WINDOW.format('date')} AS search_window FROM ev"))
def _(v):
    return v.events.select("date", search_window(F.col("date")).alias("search_window")).distinct()


# ------------------------------------------------------------------------ sinks

TRAFFIC_ROWS = "strftime(date, '%Y-%m-%d') AS date, host, visits, views, bytes"


@query("s1_upsert_by_key", sql(
    f"SELECT strftime(date, '%Y-%m-%d') AS date, host, CASE WHEN host = 'wiki.example' AND day(date) > 20 THEN visits + 1000 ELSE visits END"
    " AS visits, views, bytes FROM traffic"))
def _(v):
    root = new_folder(v.spark, "upsert")
    rows = v.tables["traffic"]
    corrected = rows.where((F.col("host") == "wiki.example") & (F.dayofmonth("date") > 20))
    corrected = corrected.withColumn("visits", F.col("visits") + 1000)
    daily.upsert(v.spark, root, "traffic", rows)
    daily.upsert(v.spark, root, "traffic", corrected)
    daily.upsert(v.spark, root, "traffic", corrected)
    return read_table(v.spark, root, "traffic")


@query("s2_replace_scope", sql(
    "SELECT strftime(date, '%Y-%m-%d') AS date, host, page, visits, views FROM landing"
    " WHERE NOT (host = 'site0.example' AND day(date) > 20) AND day(date) <> 5"))
def _(v):
    root = new_folder(v.spark, "replace")
    rows = v.tables["landing"]
    # A second run finds nothing for site0 after the 20th, and nothing at all on the 5th.
    emptied = ((F.col("host") == "site0.example") & (F.dayofmonth("date") > 20)) | (
        F.dayofmonth("date") == 5
    )
    scope = v.tables["traffic"].select("date", "host")
    daily.replace_scope(v.spark, root, "landing", rows, scope)
    daily.replace_scope(v.spark, root, "landing", rows.where(~emptied), scope.where(emptied))
    return read_table(v.spark, root, "landing")


@query("s3_guarded_refresh", sql(
    "SELECT strftime(date, '%Y-%m-%d') AS date, host, CASE WHEN host IN ('site1.example', 'site2.example', 'wiki.example')"
    " AND day(date) = 30 THEN clicks + 1 ELSE clicks END AS clicks, impressions FROM search_summary"))
def _(v):
    root = new_folder(v.spark, "guarded")
    rows = v.search_summary
    sites = CONFIG.sites_df(v.spark)
    daily.replace_scope(v.spark, root, "search_summary", rows, rows.select("date", "host"))
    again = rows.where(F.col("date") == F.lit(LAST)).withColumn("clicks", F.col("clicks") + 1)
    # No credentials: nothing is touched. Then a pull that fails for one host.
    daily.replace_scope(v.spark, root, "search_summary", again, daily.search_scope(sites, LAST, False))
    scope = daily.search_scope(sites, LAST, True, ["site0.example"])
    daily.replace_scope(v.spark, root, "search_summary", again, scope)
    return read_table(v.spark, root, "search_summary").select("date", "host", "clicks", "impressions")


@query("s4_run_log", sql(
    "SELECT strftime(run_at, '%Y-%m-%d %H:%M:%S') AS run_at, strftime(date, '%Y-%m-%d') AS date, ok, note FROM"
    " (SELECT max(date) + INTERVAL 13 HOUR AS run_at, max(date) AS date, 1::BIGINT AS ok, 'ok' AS note FROM ev"
    "  UNION ALL SELECT max(date) - INTERVAL 11 HOUR, max(date) - 1, 0, 'gsc queries a: 403 | zone traffic b' FROM ev)"))
def _(v):
    root = new_folder(v.spark, "runs")
    last = v.events.agg(F.max("date").alias("date")).first().date
    at = dt.datetime.combine(last, dt.time(13))
    day = dt.timedelta(1)
    daily.log_run(v.spark, root, at - day, last - day, ["gsc queries a: 403", "zone traffic b"])
    daily.log_run(v.spark, root, at, last, ["first try failed"])
    daily.log_run(v.spark, root, at, last)
    return read_table(v.spark, root, "runs")


@query("s5_json_export", sql("""SELECT s.host, string_agg(referrer || ':' || visits, ',' ORDER BY rank) AS referrers
  FROM sites s LEFT JOIN refs_card USING (host) GROUP BY s.host""", classified(), site_rows(7)))
def _(v):
    path = new_folder(v.spark, "export")
    report = v.full_report(7)
    daily.write_report_json(report.export(), path)
    item = "referrers ARRAY<STRUCT<rank: INT, referrer: STRING, kind: STRING, visits: BIGINT>>"
    listed = F.transform("referrers", lambda r: F.concat_ws(":", r["referrer"], r["visits"]))
    return v.spark.read.schema(f"host STRING, {item}").json(path).select(
        "host", F.array_join(listed, ",").alias("referrers")
    )


LISTS = {
    "referrers": "referrer || '|' || kind AS name, visits AS a, NULL AS b, NULL AS x, NULL AS y, rank FROM refs_card",
    "landing": "page, visits, views, NULL, NULL, rank FROM land_card",
    "files": "page, requests, zone_visits, NULL, NULL, rank FROM " + top(
        "(SELECT host, page, sum(requests)::BIGINT AS requests, sum(zone_visits)::BIGINT AS zone_visits"
        " FROM zone_pages WHERE date > DATE '2024-01-23' GROUP BY ALL)", "host", "requests DESC, page", 8),
    "keywords": "query, clicks, impressions, CASE WHEN impressions <> 0 THEN clicks / impressions ELSE 0 END, position, rank FROM "
                + top("keywords", "host", "clicks DESC, impressions DESC, query", 12),
    "pages": "page, clicks, impressions, ctr, position, rank FROM " + top("search_pages", "host", "clicks DESC, impressions DESC, page", 8),
    "countries": "country, visits, NULL, NULL, NULL, rank FROM " + top(
        "(SELECT * FROM zone_countries WHERE date = DATE '2024-01-30')", "host", "visits DESC, country", 10),
    "statuses": "status::VARCHAR, requests, NULL, NULL, NULL, rank FROM " + top(
        "(SELECT * FROM zone_status WHERE date = DATE '2024-01-30')", "host", "requests DESC, status", 8),
    "spark": "strftime(date, '%Y-%m-%d'), visits, flood::INT, NULL, NULL, row_number() OVER (PARTITION BY host ORDER BY date) FROM "
             + top("classified", "host", "date DESC", 14),
    "verified": "'verified', vr, vr + ur, vr / (vr + ur), NULL, 1 FROM (SELECT host, sum(requests) FILTER (WHERE category <> '(unverified)')::BIGINT AS vr,"
                " sum(requests) FILTER (WHERE category = '(unverified)')::BIGINT AS ur FROM zone_bots WHERE date = DATE '2024-01-30' GROUP BY host)",
    "noise": "'noise', sum(p)::BIGINT, sum(e)::BIGINT, NULL, NULL, 1 FROM (SELECT host, requests AS p, 0 AS e FROM zone_pages"
             f" WHERE date = DATE '2024-01-30' AND {non_content('page')} UNION ALL SELECT host, 0, requests FROM zone_status"
             " WHERE date = DATE '2024-01-30' AND status >= 400) GROUP BY host",
}
ENTRY = {
    "referrers": ("concat_ws('|', e.referrer, e.kind)", "e.visits", None, None, None),
    "landing": ("e.page", "e.visits", "e.views", None, None), "files": ("e.page", "e.requests", "e.zone_visits", None, None),
    "keywords": ("e.query", "e.clicks", "e.impressions", "e.ctr", "e.position"), "pages": ("e.page", "e.clicks", "e.impressions", "e.ctr", "e.position"),
    "countries": ("e.country", "e.visits", None, None, None), "statuses": ("string(e.status)", "e.requests", None, None, None),
    "spark": ("string(e.date)", "e.visits", "int(e.flood)", None, None),
}
SINGLES = {"verified": ("verified_requests", "total_requests", "verified_share"), "noise": ("path_requests", "error_requests", "NULL")}


@query("s5_json_export_lists", sql("SELECT host, list, rank::BIGINT AS rank, name, a::BIGINT AS a, b::BIGINT AS b, round(x, 6) AS x, round(y, 6) AS y FROM ("
    + " UNION ALL ".join(f"(SELECT host, '{name}' AS list, {body})" for name, body in LISTS.items()) + ") JOIN sites USING (host)", classified(), site_rows(7)))
def _(v):
    """Every entry of every list of the export, and its single rows, read back from its JSON."""
    path = new_folder(v.spark, "export")
    export = v.full_report(7).export()
    daily.write_report_json(export, path)
    back = v.spark.read.schema(export.schema).json(path)

    def entry(fields) -> list[str]:
        name, *rest = (f or "NULL" for f in fields)
        return [f"{name} AS name", *(f"{kind}({f}) AS {to}" for kind, f, to in zip(("bigint", "bigint", "double", "double"), rest, "abxy"))]

    parts = [
        back.selectExpr("host", f"posexplode({name}) AS (place_, e)").selectExpr("host", f"'{name}' AS list", "bigint(place_ + 1) AS rank", *entry(fields))
        for name, fields in ENTRY.items()
    ]
    parts += [
        back.where(F.col(fields[0]).isNotNull()).selectExpr("host", f"'{name}' AS list", "1L AS rank", *entry((f"'{name}'", *fields, None)))
        for name, fields in SINGLES.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("s6_schema_evolve", sql(
    "SELECT strftime(date, '%Y-%m-%d') AS date, host, visits, views, CASE WHEN day(date) < 15 THEN 0 ELSE bytes END AS bytes FROM traffic"))
def _(v):
    root = new_folder(v.spark, "evolve")
    rows = v.tables["traffic"]
    early = F.dayofmonth("date") < 15
    # Files of an older version have no ``bytes`` column.
    rows.where(early).drop("bytes").write.partitionBy("date").parquet(f"{root}/traffic")
    daily.upsert(v.spark, root, "traffic", rows.where(~early))
    return read_table(v.spark, root, "traffic")


# ------------------------------------------------------------------------ reads

@query("r1_report_params", sql(
    f"SELECT 7::BIGINT AS period_days, 'change' AS sort, {TRAFFIC_ROWS} FROM traffic WHERE host = 'wiki.example'"
    f" UNION ALL SELECT 1, 'traffic', {TRAFFIC_ROWS} FROM traffic"))
def _(v):
    traffic = v.tables["traffic"]
    asked = [R.report_params(CONFIG, 7, "wiki.example", "change"), R.report_params(CONFIG, 9, "no.example", "x")]
    parts = [
        R.select_domain(traffic, p)
        .withColumn("period_days", F.lit(p.period_days))
        .withColumn("sort", F.lit(p.sort))
        for p in asked
    ]
    return parts[0].unionByName(parts[1])


@query("r2_period_windows", sql("""SELECT strftime(d, '%Y-%m-%d') AS date, p::BIGINT AS period_days,
  strftime(d - (p - 1), '%Y-%m-%d') AS start, strftime(d - p, '%Y-%m-%d') AS previous_end,
  strftime(d - (2 * p - 1), '%Y-%m-%d') AS previous_start,
  strftime(least(d - (2 * p - 1), d - 29), '%Y-%m-%d') AS history_start
  FROM (SELECT max(date) AS d FROM traffic), (VALUES (1), (7), (30)) v(p)"""))
def _(v):
    return R.period_windows(v.tables["traffic"].agg(F.max("date").alias("date")))


def between(first: str, last: str) -> str:
    return f"WHERE date BETWEEN DATE '{first}' AND DATE '{last}'"


WEEK = R.Period(LAST, 7)


@query("r3_traffic_period", sql(f"SELECT {TRAFFIC_ROWS} FROM traffic {between('2024-01-24', '2024-01-30')}"))
def _(v):
    return R.within(v.tables["traffic"], WEEK, "start").drop("as_of")


@query("r3_traffic_previous", sql(f"SELECT {TRAFFIC_ROWS} FROM traffic {between('2024-01-17', '2024-01-23')}"))
def _(v):
    return R.within(v.tables["traffic"], WEEK, "previous_start", "previous_end").drop("as_of")


@query("r3_traffic_history", sql(f"SELECT {TRAFFIC_ROWS} FROM traffic {between('2024-01-01', '2024-01-30')}"))
def _(v):
    return R.within(v.tables["traffic"], WEEK).drop("as_of")


@query("r4_referrers_by_day", sql(
    f"SELECT {DATE}, host, referrer, kind, visits FROM referrers {between('2024-01-24', '2024-01-30')}"))
def _(v):
    return R.referrers_by_day(R.within(v.tables["referrers"], WEEK, "start")).drop("as_of")


@query("r5_kinds_by_day", sql(f"SELECT {DATE}, host, kind, visits FROM kinds"))
def _(v):
    return R.kinds_by_day(R.within(v.tables["referrers"], WEEK)).drop("as_of")


@query("r6_keywords_latest", sql(
    f"SELECT {DATE}, host, query, clicks, impressions, position, search_window,"
    " row_number() OVER (ORDER BY clicks DESC, impressions DESC, host, query) AS place FROM keywords WHERE date = DATE '2024-01-30'"))
def _(v):
    return placed(R.by_clicks(R.latest(v.keywords, WEEK), "query").drop("as_of"))


@query("r7_search_pages_latest", sql(
    f"SELECT {DATE}, host, page, clicks, impressions, round(ctr, 6) AS ctr, round(position, 6) AS position, search_window,"
    " row_number() OVER (ORDER BY clicks DESC, impressions DESC, host, page) AS place"
    " FROM search_pages WHERE date = DATE '2024-01-30'"))
def _(v):
    return placed(R.by_clicks(R.latest(v.search_pages, WEEK), "page").drop("as_of"))


@query("r8_search_summary_history", sql(
    f"SELECT {DATE}, host, clicks, impressions, round(ctr, 6) AS ctr, position, search_window FROM search_summary"))
def _(v):
    return R.within(v.search_summary, WEEK).drop("as_of")


@query("r9_landing_period", sql(
    f"SELECT {DATE}, host, page, visits, views FROM landing {between('2024-01-24', '2024-01-30')}"))
def _(v):
    return R.within(v.tables["landing"], WEEK, "start").drop("as_of")


@query("r10_zone_countries_latest", sql(
    f"SELECT {DATE}, host, country, visits, row_number() OVER (ORDER BY visits DESC, host, country) AS place"
    " FROM zone_countries WHERE date = DATE '2024-01-30'"))
def _(v):
    rows = R.latest(v.tables["zone_countries"], WEEK).drop("as_of")
    return placed(rows.orderBy(F.desc("visits"), "host", "country"))


@query("r11_zone_status_history", sql(f"SELECT {DATE}, host, status, requests FROM zone_status"))
def _(v):
    rows = R.within(v.tables["zone_status"], WEEK).drop("as_of")
    return rows.orderBy("date", F.desc("requests"), "host", "status")


@query("r12_zone_bots_latest", sql(
    f"SELECT {DATE}, host, category, requests, visits, row_number() OVER (ORDER BY requests DESC, host, category) AS place"
    " FROM zone_bots WHERE date = DATE '2024-01-30'"))
def _(v):
    rows = R.latest(v.tables["zone_bots"], WEEK).drop("as_of")
    return placed(rows.orderBy(F.desc("requests"), "host", "category"))


@query("r13_forum_history", sql(
    f"SELECT {DATE}, host, users_count, active_today, active_7d, active_30d, new_today, new_7d, new_30d,"
    " posts_today, posts_count, topics_count FROM forum"))
def _(v):
    return R.within(v.forum, WEEK).drop("as_of").orderBy("date", "host")


@query("r14_dates_available", sql(
    "SELECT count(DISTINCT date) FILTER (WHERE date >= DATE '2024-01-24') AS days_available,"
    " count(DISTINCT date) FILTER (WHERE date BETWEEN DATE '2024-01-17' AND DATE '2024-01-23') AS previous_days_available,"
    " strftime(min(date) FILTER (WHERE date >= DATE '2024-01-24'), '%Y-%m-%d') AS coverage_start FROM traffic"))
def _(v):
    return R.dates_available(v.tables["traffic"], WEEK)


# ------------------------------------------------------------------------ joins

@query("j1_beacons_x_aliases", sql(
    "SELECT raw_host, host, count(*) AS n FROM rum GROUP BY ALL"))
def _(v):
    known = B.resolve_hosts(v.beacons, CONFIG.aliases_df(v.spark))
    return known.groupBy("raw_host", "host").agg(F.count("*").alias("n"))


@query("j2_beacons_x_exclude_list", sql(
    "SELECT host, path, count(*) AS n FROM counted GROUP BY ALL", [COUNTED]))
def _(v):
    return v.counted.groupBy("host", "path").agg(F.count("*").alias("n"))


@query("j3_traffic_x_direct", sql(
    f"SELECT {DATE}, host, visits, views, direct FROM shape", classified()))
def _(v):
    report = v.report()
    return report.split.select("date", "host", "visits", "views", "direct")


@query("j4_landing_without_floods", sql(
    f"SELECT {DATE}, host, page, visits, views FROM landing WHERE (host, date) NOT IN (SELECT (host, date) FROM floods)",
    classified()))
def _(v):
    report = v.report(30)
    kept = report.rows("landing", "start").join(report.floods, ["as_of", "host", "date"], "left_anti")
    return kept.drop("as_of")


@query("j5_referrers_without_flooded_direct", sql(
    "SELECT host, referrer, kind, visits FROM refs", classified(), site_rows(7)))
def _(v):
    return v.report(7).referrers.drop("as_of")


@query("j6_measured_error_days", sql(
    f"""SELECT {DATE}, host, t.views AS requests, e.error_requests, round(e.error_requests / t.views, 6) AS error_share
  FROM traffic t JOIN (SELECT date, host, coalesce(sum(requests) FILTER (WHERE status >= 400), 0)::BIGINT AS error_requests
    FROM zone_status GROUP BY ALL) e USING (date, host) WHERE t.views > 0"""))
def _(v):
    report = v.report()
    return H.error_series(report.statuses, report.rows("traffic")).drop("as_of")


@query("j7_sites_left", sql(
    "SELECT host, measurement, visits, previous_visits FROM st", classified(), site_rows(7)))
def _(v):
    return v.report(7).traffic.select("host", "measurement", "visits", "previous_visits")


@query("j8_period_days", sql(
    f"SELECT strftime(t.date, '%Y-%m-%d') AS date, t.host, coalesce(human, 0) AS human, coalesce(crawler, 0) AS crawler,"
    " coalesce(human_views, 0) AS human_views, coalesce(crawler_views, 0) AS crawler_views,"
    " coalesce(partial, false) AS partial FROM (FROM traffic UNION ALL SELECT * REPLACE ('idle.example' AS host) FROM traffic WHERE host = 'site0.example') t"
    " LEFT JOIN split s ON s.host = t.host AND s.date = t.date WHERE t.date > DATE '2024-01-23'", classified()))
def _(v):
    report = v.report(7)
    rows = R.within(v.tables["traffic"], WEEK, "start")
    # A site that was never classified still has its days, as zeros.
    idle = rows.where(F.col("host") == "site0.example").withColumn("host", F.lit("idle.example"))
    return E.split_stored_days(rows.unionByName(idle), report.split).drop("as_of")


@query("j9_trend_x_search", sql(
    """SELECT strftime(d.date, '%Y-%m-%d') AS date, d.visits, d.views, coalesce(s.visits, 0)::BIGINT AS search FROM
  (SELECT date, sum(human)::BIGINT AS visits, sum(human_views)::BIGINT AS views FROM split
   WHERE host <> 'files.example' GROUP BY date) d LEFT JOIN
  (SELECT date, sum(visits) AS visits FROM kinds WHERE kind = 'search' GROUP BY date) s USING (date)""", classified()))
def _(v):
    report = v.report()
    return T.traffic_trend(report.split, report.kinds, report.sites)


@query("j10_keywords_x_deny", sql(
    "SELECT host, query, clicks, impressions FROM keywords k WHERE NOT EXISTS (SELECT 1 FROM deny d"
    " WHERE d.host = k.host AND regexp_matches(k.query, '(?i)' || d.pattern))"))
def _(v):
    kept = O.drop_denied(v.keywords, CONFIG.deny(v.spark))
    return kept.select("host", "query", "clicks", "impressions")


GRANTED = """granted AS (SELECT CASE host WHEN 'wiki.example' THEN 'http://wiki.example/'
    WHEN 'files.example' THEN 'sc-domain:other.example' ELSE 'sc-domain:' || host END AS property,
  CASE WHEN sum(clicks) % 2 = 0 THEN 'siteOwner' ELSE 'siteFullUser' END AS level
  FROM search_summary WHERE host <> 'site2.example' GROUP BY host)"""


@query("n1_property_audit", sql("""SELECT c.host, coalesce(c.property, g.property) AS property,
  CASE WHEN c.host IS NULL THEN 'unused' WHEN g.level IS NOT NULL THEN 'ok' ELSE 'missing' END AS status, g.level,
  CASE WHEN g.level IS NULL THEN (SELECT s.property FROM granted s WHERE s.property = replace(c.property, 'https:', 'http:')
    AND s.property <> c.property) END AS swapped
  FROM (VALUES ('site0.example', 'sc-domain:site0.example'), ('site1.example', 'sc-domain:site1.example'),
    ('site2.example', 'sc-domain:site2.example'), ('wiki.example', 'https://wiki.example/')) c(host, property)
  FULL OUTER JOIN granted g ON g.property = c.property""", [GRANTED]))
def _(v):
    host = F.col("host")
    property_ = (
        F.when(host == "wiki.example", "http://wiki.example/")
        .when(host == "files.example", "sc-domain:other.example")
        .otherwise(F.concat(F.lit("sc-domain:"), host))
    )
    level = F.when(F.col("clicks") % 2 == 0, "siteOwner").otherwise("siteFullUser")
    granted = (
        v.search_summary.where(host != "site2.example")
        .groupBy("host")
        .agg(F.sum("clicks").alias("clicks"))
        .select(property_.alias("property"), level.alias("level"))
    )
    return N.property_audit(CONFIG.sites_df(v.spark), granted)
