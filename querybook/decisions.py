"""H: signals, K: forums, L: digest, M: panels, X: further lenses on the same rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from querybook.registry import query
from querybook.sql import DATE, OPPORTUNITIES, classified, malformed, non_content, site_rows, sql, top
from querybook.views import CONFIG, FLOOD_RULES, LAST, NO_FLOODS, SIGNAL_RULES
from tidegauge import constants as C
from tidegauge.functions.scalars import is_malformed
from tidegauge.operators import digest as L
from tidegauge.operators import forums as K
from tidegauge.operators import panels as M
from tidegauge.operators import reads as R
from tidegauge.operators import signals as H
from tidegauge.operators import sites as P
from tidegauge.operators import totals as T
from tidegauge.operators import zone as Z
from tidegauge.plans.nightly import record_signals
from tidegauge.plans.report import Report, Tables
from tidegauge.sinks import daily
from tidegauge.sinks.scratch import new_folder
from tidegauge.sources.tables import read_table

SIGNAL = ["severity", "kind", "host", "headline", "weight", "recurrence"]


def fired(severity: int, kind: str, headline: str, weight: str, source: str, recurrence: str = "NULL::BIGINT") -> str:
    return (
        f"SELECT {severity}::BIGINT AS severity, '{kind}' AS kind, host, {headline} AS headline,"
        f" round(({weight})::DOUBLE, 6) AS weight, {recurrence} AS recurrence FROM {source}"
    )


def pct(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5)::BIGINT || '%')"


ERRORS = [
    """errors AS (SELECT date, host, t.views AS requests, e.n AS error_requests, e.n / t.views AS share FROM traffic t
  JOIN (SELECT date, host, coalesce(sum(requests) FILTER (WHERE status >= 400), 0) AS n FROM zone_status GROUP BY ALL) e
  USING (date, host) WHERE t.views > 0)""",
    """spikes AS (SELECT * FROM (SELECT *, avg(share) OVER w AS mean, count(*) OVER w AS n FROM errors
  WINDOW w AS (PARTITION BY host ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
  WHERE date = DATE '2024-01-30' AND n >= 3 AND error_requests >= 20 AND share >= 0.02
    AND (share >= mean * 2 OR share - mean >= 0.05))""",
]
LANDING_FACTS = f"""lf AS (SELECT host, max(page) FILTER (WHERE rank = 1) AS top_page, max(visits) FILTER (WHERE rank = 1) AS top_entries,
  sum(visits) AS listed, count(*) FILTER (WHERE {malformed('page')}) AS bad FROM land_card GROUP BY host)"""
RUN = """run AS (SELECT host, count(*) AS flood_run FROM (SELECT host, date, row_number() OVER (PARTITION BY host ORDER BY date DESC) AS n
  FROM floods) WHERE DATE '2024-01-30' - date = n - 1 GROUP BY host)"""
GAPS = """gaps AS (SELECT host, kind, count(*) AS n, sum(score) AS clicks FROM opps
  WHERE host <> 'files.example' GROUP BY host, kind)"""

RUM = "sr WHERE measurement = 'rum'"
CHANGE = "abs(visits - previous_visits)"
NOT_SUBFLOOD = ("NOT coalesce(delta >= 1 AND visits - previous_visits >= 50 AND visits >= 100 AND pages_per_session > 0"
                " AND pages_per_session <= 1.15 AND direct / visits >= 0.6 AND top_entries / greatest(listed, visits) >= 0.03, false)")
JOINED = "(SELECT sr.*, direct, top_page, top_entries, listed FROM sr JOIN sources USING (host) LEFT JOIN lf USING (host)) WHERE measurement = 'rum'"

SUBFLOOD = fired(1, "likely-bot-subflood", "host || ' is up ' || " + pct("delta") + " || ', and it looks like a crawler rather than growth'",
                 CHANGE, JOINED + " AND " + NOT_SUBFLOOD[4:])
ERROR_SPIKE = fired(1, "error-spike", "host || ' error responses are ' || printf('%.1f', share * 100) || '% of requests'",
                    "error_requests", "spikes")


def gap(kind: str, tail: str) -> str:
    return fired(2, f"{kind}-gap", f"host || ' has ' || n || CASE WHEN n = 1 THEN ' query' ELSE ' queries' END || '{tail}'",
                 "clicks", f"gaps WHERE kind = '{kind}'")


SNIPPET = gap("snippet", " ranking well but not clicked")
RANK = gap("rank", " ranking too deep to be seen")
DROP = fired(2, "traffic-drop", "host || ' sessions fell ' || " + pct("abs(delta)"), CHANGE,
             RUM + f" AND delta <= -0.10 AND {CHANGE} >= 5")
RISE = fired(3, "traffic-rise", "host || ' sessions rose ' || " + pct("delta"), CHANGE,
             JOINED + f" AND {NOT_SUBFLOOD} AND delta >= 0.10 AND {CHANGE} >= 5")


def no_comparison(recurrence: str) -> str:
    return fired(3, "no-comparison", "host || ' has no like-for-like comparison'", "visits",
                 "sr LEFT JOIN run USING (host) WHERE measurement = 'rum' AND delta IS NULL"
                 " AND (partial_days > 0 OR previous_partial_days > 0)", recurrence)


def rule(v_report, name):
    return v_report.signals([name]).select(*SIGNAL)


@query("h1_error_spike", sql(ERROR_SPIKE, ERRORS))
def _(v):
    return rule(v.report(), "error-spike")


@query("h1_error_baseline", sql(
    "SELECT host, error_requests::BIGINT AS error_requests, round(share, 6) AS error_share, round(mean, 6) AS error_mean, n AS error_days FROM spikes",
    ERRORS))
def _(v):
    report = v.report()
    series = H.error_series(report.statuses, report.rows("traffic"))
    return H.error_facts(series, SIGNAL_RULES).drop("as_of", "error_base")


@query("h2_top_landing_share", sql(
    "SELECT host, top_page, top_entries, round(top_entries / greatest(listed, visits), 6) AS share FROM st JOIN lf USING (host)",
    classified(), site_rows(7), [LANDING_FACTS]))
def _(v):
    report = v.report(7)
    facts = H.landing_facts(report.landing_card).join(report.traffic.select("as_of", "host", "visits"), ["as_of", "host"])
    return facts.select("host", "top_page", "top_entries", H.top_landing_share().alias("share"))


@query("h3_likely_bot_subflood", sql(
    SUBFLOOD, classified(min_visits=10**9, last="2024-01-29"), site_rows(1, "2024-01-29"), [LANDING_FACTS]))
def _(v):
    return rule(v.report(1, LAST - dt.timedelta(1), NO_FLOODS), "likely-bot-subflood")


MALFORMED_LANDING = [
    """url_landing AS (SELECT 'site' || (page_id % 3) || '.example' AS host, path AS page,
  sum(page_id % 17)::BIGINT AS visits FROM url_rows GROUP BY 1, 2)""",
    "url_card AS " + top("url_landing", "host", "visits DESC, page", 8),
]


def url_report(v) -> Report:
    """A report whose landing pages are the crawled URLs, damaged ones among them."""
    host = F.concat(F.lit("site"), F.col("page_id") % 3, F.lit(".example"))
    landing = (
        v.url_rows.groupBy(host.alias("host"), F.col("path").alias("page"))
        .agg(F.sum(F.col("page_id") % 17).alias("visits"))
        .withColumn("views", F.col("visits"))
        .withColumn("date", F.lit(LAST))
    )
    tables = Tables(v.spark, {**v.tables.frames, "landing": landing})
    report = v.report(tables=tables)
    return replace(report, signal_rules=replace(SIGNAL_RULES, malformed_min_paths=1))


@query("h4_malformed_urls", sql(
    fired(2, "malformed-urls", "host || ' is serving ' || n || ' malformed URLs'", "n * 10",
          f"(SELECT host, count(*) AS n FROM url_card WHERE {malformed('page')} GROUP BY host)"),
    MALFORMED_LANDING))
def _(v):
    return rule(url_report(v), "malformed-urls")


@query("h5_snippet_gap", sql(SNIPPET, OPPORTUNITIES, [GAPS]))
def _(v):
    return rule(v.report(), "snippet-gap")


@query("h6_rank_gap", sql(RANK, OPPORTUNITIES, [GAPS]))
def _(v):
    return rule(v.report(), "rank-gap")


@query("h7_traffic_drop", sql(DROP, classified(), site_rows(7)))
def _(v):
    return rule(v.report(7), "traffic-drop")


@query("h8_traffic_rise", sql(RISE, classified(), site_rows(1), [LANDING_FACTS]))
def _(v):
    return rule(v.report(), "traffic-rise")


@query("h9_no_comparison", sql(no_comparison("flood_run"), classified(), site_rows(1), [RUN]))
def _(v):
    return rule(v.report(), "no-comparison")


def all_signals(days: int) -> str:
    run = "flood_run" if days == 1 else "NULL::BIGINT"
    parts = [ERROR_SPIKE, SUBFLOOD, SNIPPET, RANK, DROP, RISE, no_comparison(run)]
    return "(" + " UNION ALL ".join(parts) + ")"


def signal_ctes(days: int) -> list:
    return [classified(), site_rows(days), ERRORS, [LANDING_FACTS, RUN], OPPORTUNITIES, [GAPS]]


for _days in (1, 7):

    @query(f"h10_rank_signals_{_days}d", sql(f"SELECT * FROM {all_signals(_days)}", *signal_ctes(_days)))
    def _(v, days=_days):
        report = v.full_report(days)
        return H.rank_signals(report.signals()).select(*SIGNAL)


def with_commas(x: str) -> str:
    return f"format('{{:,}}', ({x})::BIGINT)"


def one_place(x: str) -> str:
    """One decimal; exact ties go up."""
    return f"printf('%.1f', {x} + 1e-9)"


MOVED = f" || {with_commas('abs(visits - previous_visits)')} || ' from ' || {with_commas('previous_visits')} || '.'"
LEAD = ("(SELECT *, sum(score) OVER (PARTITION BY host, kind) AS clicks_lost, row_number() OVER (PARTITION BY host, kind ORDER BY score DESC, query) AS n"
        " FROM opps WHERE host <> 'files.example') WHERE n = 1 AND kind = ")
# Evidence of each rule, and the rows on which it fires.
TEXTS = {
    "traffic-drop": (f"{with_commas('visits')} || ' sessions, down '" + MOVED, RUM + f" AND delta <= -0.10 AND {CHANGE} >= 5"),
    "traffic-rise": (f"{with_commas('visits')} || ' sessions, up '" + MOVED, JOINED + f" AND {NOT_SUBFLOOD} AND delta >= 0.10 AND {CHANGE} >= 5"),
    "no-comparison": (
        f"{with_commas('visits')} || ' sessions is a floor: ' || CASE WHEN partial_days > 0 THEN 'this' ELSE 'the previous' END"
        " || ' period contains a crawler-flooded day whose direct bucket is not separable.'",
        "sr WHERE measurement = 'rum' AND delta IS NULL AND (partial_days > 0 OR previous_partial_days > 0)"),
    "error-spike": (
        f"{with_commas('error_requests')} || ' responses ≥ 400 out of ' || {with_commas('requests')} || ' requests, against a ' || n"
        f" || '-day mean of ' || {one_place('mean * 100')} || '%.'", "spikes"),
    "snippet-gap": (
        f"'About ' || {one_place('clicks_lost')} || ' clicks a window are going elsewhere, led by \"' || query || '\" at position ' || {one_place('position')}"
        f" || ' with ' || {one_place('ctr * 100')} || '% CTR against roughly ' || {one_place('expected_ctr * 100')} || '% expected there.'", LEAD + "'snippet'"),
    "rank-gap": (
        f"'Roughly ' || {one_place('clicks_lost')} || ' clicks a window are out of reach at these ranks, led by \"' || query || '\" at position '"
        f" || {one_place('position')} || ' on ' || {with_commas('impressions')} || ' impressions.'", LEAD + "'rank'"),
}


@query("h10_signal_texts", sql(" UNION ALL ".join(
    f"SELECT host, '{kind}' AS kind, {evidence} AS evidence, '{C.ACTIONS[kind]}' AS action,"
    f" '#site-' || regexp_replace(host, '[^a-zA-Z0-9]', '-', 'g') AS href FROM {rows}" for kind, (evidence, rows) in TEXTS.items()), *signal_ctes(7)))
def _(v):
    """The text columns of the signals: evidence, action and link."""
    return v.full_report(7).signals(list(TEXTS)).select("host", "kind", "evidence", "action", "href")


URGENCY = "ORDER BY severity, weight DESC, host"


@query("h11_todays_actions", sql(
    f"SELECT * FROM {all_signals(1)} WHERE severity <= 2 {URGENCY} LIMIT 3", *signal_ctes(1)))
def _(v):
    return H.todays_actions(v.full_report().signals()).select(*SIGNAL)


@query("h12_top_alert", sql(
    f"SELECT * FROM {all_signals(1)} WHERE severity = 1 {URGENCY} LIMIT 1", *signal_ctes(1)))
def _(v):
    return H.top_alert(v.full_report().signals()).select(*SIGNAL)


# ------------------------------------------------------- forums, digest, panels

COUNTERS = ["users_count", "active_today", "active_7d", "active_30d", "new_today", "new_7d", "new_30d",
            "posts_today", "posts_count", "topics_count"]


@query("k1_forum_report", sql(
    "SELECT c.host, c.name, " + ", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in COUNTERS)
    + """, coalesce(round(m.mean, 6), 0) AS mean_active_today, m.mean IS NOT NULL AS has_data
  FROM (VALUES ('forum0.example', 'Forum Zero'), ('forum1.example', 'Forum One'), ('forum2.example', 'Forum Two')) c(host, name)
  LEFT JOIN (SELECT * FROM forum WHERE date = DATE '2024-01-30') f USING (host)
  LEFT JOIN (SELECT host, avg(active_today) AS mean FROM """ + top("forum", "host", "date DESC", 14)
    + " GROUP BY host) m USING (host)"))
def _(v):
    return K.forum_report(CONFIG.forums_df(v.spark), v.report().rows("forums"))


@query("k1_forum_sparkline", sql(
    f"SELECT host, {DATE}, active_today AS visits FROM " + top("forum", "host", "date DESC", 14)))
def _(v):
    return K.forum_sparkline(v.report().rows("forums"))


TODAY = "split WHERE date = DATE '2024-01-30'"


@query("l1_daily_digest", sql(
    f"SELECT sum(human)::BIGINT AS human_visits, sum(crawler)::BIGINT AS bot_visits,"
    f" string_agg(host, ', ' ORDER BY host) FILTER (WHERE flood) AS flooded FROM {TODAY}", classified()))
def _(v):
    report = v.report()
    return L.daily_digest(report.split, report.sites)


@query("l2_digest_ranked", sql(
    "SELECT rank, host, human FROM " + top(f"(SELECT * FROM {TODAY} AND human > 0)", "date", "human DESC, host", 4),
    classified()))
def _(v):
    report = v.report()
    return L.digest_ranked(report.split, report.sites)


@query("l2_digest_body", sql(
    f"""SELECT human_visits, bot_visits, flooded, human_visits || ' visitors (24h)' || chr(10) || lines || chr(10) || '🤖 ' || bot_visits
  || ' crawler sessions excluded (' || flooded || ')' || chr(10) || chr(10) || '❗ ' || headline || chr(10)
  || '→ Check the top failing paths below and fix or redirect them.' AS body FROM
  (SELECT sum(human)::BIGINT AS human_visits, sum(crawler)::BIGINT AS bot_visits,
    string_agg(host, ', ' ORDER BY host) FILTER (WHERE flood) AS flooded FROM {TODAY}),
  (SELECT string_agg(host || ': ' || human, chr(10) ORDER BY rank) AS lines FROM """
    + top(f"(SELECT * FROM {TODAY} AND human > 0)", "date", "human DESC, host", 4)
    + f"), ({ERROR_SPIKE})", classified(), ERRORS))
def _(v):
    report = v.full_report()
    digest = L.daily_digest(report.split, report.sites)
    ranked = L.digest_ranked(report.split, report.sites)
    return L.digest_body(digest, ranked, H.top_alert(report.signals(["error-spike"])))


@query("l2_raw_ranked", sql(
    "SELECT rank, host, visits AS human FROM "
    + top("(SELECT * FROM traffic WHERE date = DATE '2024-01-30')", "date", "visits DESC, host", 4)))
def _(v):
    return L.headline_from_traffic(R.latest(v.tables["traffic"], R.Period(LAST)))


@query("l3_run_result", sql(
    f"""SELECT '2024-01-30' AS date, (SELECT sum(visits)::BIGINT FROM traffic WHERE date = DATE '2024-01-30') AS total_visits,
  human_visits, bot_visits, false AS search_ok, 'site1.example' AS failed_hosts, 'error-spike' AS top_kind,
  host AS top_host, headline AS top_headline, 'gsc queries site1.example: 403' AS notes FROM
  (SELECT sum(human)::BIGINT AS human_visits, sum(crawler)::BIGINT AS bot_visits FROM {TODAY}), ({ERROR_SPIKE})""",
    classified(), ERRORS))
def _(v):
    report = v.full_report()
    digest = L.daily_digest(report.split, report.sites)
    today = R.latest(report.tables["traffic"], report.periods)
    return L.run_result(
        today, digest, H.top_alert(report.signals(["error-spike"])), F.lit(LAST),
        ("gsc queries site1.example: 403",), ("site1.example",),
    )


BAR = "greatest(7, floor({0} / greatest(1, {1}) * 100 + 0.5))::BIGINT"


@query("m1_referrer_share", sql(
    f"""SELECT host, referrer, kind, visits, rank, round(visits / sum(visits) OVER (PARTITION BY host), 6) AS share,
  CASE WHEN kind = 'direct' THEN 100 ELSE {BAR.format('visits', "max(visits) FILTER (WHERE kind <> 'direct') OVER (PARTITION BY host)")} END AS bar,
  CASE WHEN referrer = '(direct)' THEN 'Direct / none' ELSE referrer END AS label,
  CASE kind WHEN 'ref' THEN 'referral' WHEN 'ai' THEN 'AI' ELSE kind END AS tag FROM refs_card""",
    classified(), site_rows(7)))
def _(v):
    return M.referrer_share(P.referrer_card(v.report(7).referrers)).drop("as_of")


@query("m2_country_share", sql(
    f"SELECT host, country, visits, round(visits / sum(visits) OVER (PARTITION BY host), 6) AS share,"
    f" {BAR.format('visits', 'max(visits) OVER (PARTITION BY host)')} AS bar FROM "
    + top("zone_countries", "date, host", "visits DESC, country", 10) + " WHERE date = DATE '2024-01-30'"))
def _(v):
    card = P.country_card(v.report().rows("zone_countries", "date"))
    return M.country_share(card).select("host", "country", "visits", "share", "bar")


@query("m3_status_share", sql(
    "SELECT host, status, requests, round(requests / sum(requests) OVER (PARTITION BY host), 6) AS share,"
    " status >= 400 AS is_error FROM zone_status WHERE date = DATE '2024-01-30'"))
def _(v):
    card = P.status_card(v.report().rows("zone_status", "date"))
    return M.status_share(card).select("host", "status", "requests", "share", "is_error")


@query("m4_channel_share", sql(
    """SELECT channel, sessions::BIGINT AS sessions, round(sessions / v, 6) AS share, channel <> 'unattributed' AS is_channel FROM
  (UNPIVOT (SELECT sum(direct) AS direct, sum(search) AS search, sum(social) AS social, sum(referral) AS referral,
     sum(internal) AS internal, sum(unattributed) AS unattributed FROM sources WHERE measurement = 'rum')
   ON direct, search, social, referral, internal, unattributed INTO NAME channel VALUE sessions),
  (SELECT sum(visits) AS v FROM st WHERE measurement = 'rum')""", classified(), site_rows(7)))
def _(v):
    report = v.report(7)
    measured = T.internal_measured(report.period_referrers, report.sites)
    return M.channel_share(T.source_mix(report.sources), measured, T.rum_totals(report.traffic))


@query("m5_crawler_hosts", sql(
    "SELECT host, bot_visits, bot_days, partial_visits, round(bot_visits / (SELECT sum(visits + bot_visits) FROM st WHERE measurement = 'rum'), 6) AS share"
    " FROM st WHERE measurement = 'rum' AND bot_visits > 0", classified(), site_rows(30)))
def _(v):
    return M.crawler_hosts(v.report(30).traffic)


@query("m6_panel_notes", sql(
    """SELECT host, measurement, partial_days > 0 AS flooded, CASE WHEN partial_days > 0 THEN 'Human figures above cover the ' || clean_days
    || ' clean days, plus ' || partial_visits || ' referred sessions that survived the flooded days'
    WHEN measurement = 'rum' THEN 'Human figures above cover the ' || clean_days || ' clean days.' END AS note FROM st""",
    classified(), site_rows(7)))
def _(v):
    sites = v.report(7).traffic
    notes = M.panel_notes(sites).join(sites.select("host", (F.col("partial_days") > 0).alias("flooded")), "host")
    first = F.when(F.col("flooded"), F.substring_index("note", ". A crawler", 1)).when(
        F.col("measurement") == "rum", F.col("note")
    )
    return notes.select("host", "measurement", "flooded", first.alias("note"))


@query("m6_first_noise_paths", sql(
    "SELECT host, page, requests, rank FROM " + top(
        f"(SELECT host, page, sum(requests)::BIGINT AS requests FROM zone_pages WHERE date = DATE '2024-01-30'"
        f" AND {non_content('page')} GROUP BY ALL)", "host", "requests DESC, page", 5)))
def _(v):
    paths = Z.non_content_paths(v.report().rows("zone_pages", "date"))
    return M.first_of_lens(paths, "page").drop("as_of")


@query("m6_first_error_statuses", sql(
    "SELECT host, status, requests, rank FROM " + top(
        "(SELECT host, status, requests FROM zone_status WHERE date = DATE '2024-01-30' AND status >= 400)",
        "host", "requests DESC, status", 5)))
def _(v):
    statuses = Z.error_statuses(v.report().rows("zone_status", "date"))
    return M.first_of_lens(statuses, "status").drop("as_of")


# ---------------------------------------------------------------- further lenses


@query("x1_failing_paths", sql(
    f"SELECT {DATE}, host, path, status, sum(requests)::BIGINT AS requests FROM zone_log WHERE status >= 400 GROUP BY ALL"))
def _(v):
    return Z.failing_paths(v.zone_log)


@query("x2_content_vs_noise", sql(
    f"SELECT {DATE}, host, page, requests, CASE WHEN {non_content('page')} THEN 'noise' ELSE 'content' END AS lens FROM zone_pages"))
def _(v):
    marked = Z.content_and_noise(v.tables["zone_pages"])
    return marked.select("date", "host", "page", "requests", "lens")


@query("x3_malformed_rows", sql(f"SELECT host, page, visits, {malformed('page')} AS malformed FROM url_landing", MALFORMED_LANDING))
def _(v):
    rows = url_report(v).landing
    return rows.select("host", "page", "visits", is_malformed(F.col("page")).alias("malformed"))


def dated_signals() -> list[str]:
    """Drop, rise and no-comparison of each of the last seven report dates, one day against the day before."""
    dates = [(LAST - dt.timedelta(n)).isoformat() for n in range(7)]
    ctes = []
    for n, date in enumerate(dates):
        first = (dt.date.fromisoformat(date) - dt.timedelta(29)).isoformat()
        inner = "WITH " + ",\n".join([*classified(first=first, last=date), *site_rows(1, date)[:3]])
        body = " UNION ALL ".join(
            f"SELECT DATE '{date}' AS as_of, {severity} AS severity, '{kind}' AS kind, host FROM {where}"
            for severity, kind, where in [
                (2, "traffic-drop", RUM + f" AND delta <= -0.10 AND {CHANGE} >= 5"),
                (3, "no-comparison", "sr WHERE measurement = 'rum' AND delta IS NULL"
                 " AND (partial_days > 0 OR previous_partial_days > 0)"),
            ]
        )
        ctes.append(f"day{n} AS ({inner} {body})")
    union = " UNION ALL ".join(f"SELECT * FROM day{n}" for n in range(7))
    return [*ctes, f"dated AS ({union})"]


@query("x4_recurrence", sql(
    """SELECT strftime(as_of, '%Y-%m-%d') AS as_of, kind, host, n - 1 AS recurrence,
  (CASE WHEN n - 1 >= 2 THEN greatest(severity - 1, 1) ELSE severity END)::BIGINT AS severity FROM
  (SELECT *, row_number() OVER (PARTITION BY kind, host, island ORDER BY as_of) AS n FROM
    (SELECT *, as_of - (row_number() OVER (PARTITION BY kind, host ORDER BY as_of))::INT AS island FROM dated))""",
    dated_signals()))
def _(v):
    periods = [R.Period(LAST - dt.timedelta(n)) for n in range(7)]
    report = replace(v.report(), periods=periods)
    found = report.signals(["traffic-drop", "no-comparison"])
    return H.recurrence(found, escalate_at=2).select("as_of", "kind", "host", "recurrence", "severity")


@query("x5_stored_recurrence", sql(
    """SELECT strftime(as_of, '%Y-%m-%d') AS date, kind, host, n - 1 AS recurrence,
  (CASE WHEN n - 1 >= 2 THEN greatest(severity - 1, 1) ELSE severity END)::BIGINT AS severity FROM
  (SELECT *, row_number() OVER (PARTITION BY kind, host, island ORDER BY as_of) AS n FROM
    (SELECT *, as_of - (row_number() OVER (PARTITION BY kind, host ORDER BY as_of))::INT AS island FROM dated))""",
    dated_signals()))
def _(v):
    """The same from a stored history: four dates at once, then one night, then two; one night again."""
    root = new_folder(v.spark, "signals")
    for days in ((6, 5, 4, 3), (2,), (1, 0), (0,)):
        with daily.Batch(v.spark, root) as batch:
            record_signals(batch, v.config, [LAST - dt.timedelta(n) for n in days], v.tables,
                           ["traffic-drop", "no-comparison"], 2, flood_rules=FLOOD_RULES, signal_rules=SIGNAL_RULES)
    return read_table(v.spark, root, "signals").select("date", "kind", "host", "recurrence", "severity")
