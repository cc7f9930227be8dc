"""The same derived tables as SQL, for the check of every query.

``sql(body, *more)`` puts the common table expressions below in front of a body;
an engine only computes the ones that the body refers to.
"""

from __future__ import annotations

from tidegauge import constants as C


def _any_of(column: str, fragments) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{f}')" for f in fragments) + ")"


def kind_case(referrer: str, internal: str = "false") -> str:
    return (
        f"CASE WHEN coalesce({referrer}, '') IN ('', '(direct)') THEN 'direct'"
        f" WHEN {internal} THEN 'internal'"
        f" WHEN {_any_of(referrer, C.AI_ANSWER_ENGINES)} THEN 'ai'"
        f" WHEN {_any_of(referrer, C.SEARCH_ENGINES)} THEN 'search'"
        f" WHEN {_any_of(referrer, C.SOCIAL_NETWORKS)} THEN 'social' ELSE 'ref' END"
    )


def ctr_case(p: str) -> str:
    """Expected click-through rate, written from the anchors."""
    parts = [f"CASE WHEN {p} <= 1 THEN 0.285::DOUBLE"]
    for (x1, y1), (x2, y2) in zip(C.CTR_ANCHORS, C.CTR_ANCHORS[1:]):
        parts.append(
            f"WHEN {p} <= {x2} THEN {y1}::DOUBLE * pow({y2}::DOUBLE / {y1}::DOUBLE,"
            f" ({p} - {x1}) / {x2 - x1}::DOUBLE)"
        )
    return " ".join([*parts, "ELSE 0.001::DOUBLE END"])


def malformed(path: str) -> str:
    return (
        f"(regexp_matches({path}, '(?i)%3[ce]') OR regexp_matches({path}, '[<>]')"
        f" OR regexp_matches({path}, '(?i)/(span|iframe|noscript)(%3e|>|/|$)')"
        f" OR contains(regexp_replace(substr({path}, 2), '(?i)^[a-z][a-z0-9+.-]*://', ''), '//')"
        f" OR regexp_matches({path}, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)'))"
    )


NON_CONTENT = (
    "regexp_matches(lower({0}), '^/robots\\.txt$|^/favicon\\.ico$|^/sitemap[^/]*$"
    "|^/\\.well-known(/|$)|^/cdn-cgi(/|$)')"
)


def non_content(path: str) -> str:
    return NON_CONTENT.format(path)


def top(table: str, by: str, order: str, n: int, columns: str = "*") -> str:
    return (
        f"(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order})"
        f" AS rank FROM {table}) WHERE rank <= {n})"
    )


HOST_BY = (
    "['site0.example','site1.example','site2.example','wiki.example','files.example'][({0})::INT + 1]"
)

WINDOW = (
    "strftime({0} - INTERVAL 4 DAY, '%Y-%m-%d') || '–' || strftime({0} - INTERVAL 2 DAY, '%Y-%m-%d')"
)

BASE = [
    """ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS date,
  day(ts) AS dd, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    """rum0 AS (SELECT *,
  CASE WHEN dd IN (10, 29, 30) AND event_type IN ('view', 'error') THEN 'wiki.example'
       WHEN user_id % 5 = 1 THEN 'wiki.example'
       ELSE 'site' || (user_id % 3) || '.example' END AS host,
  CASE WHEN event_type IN ('view', 'error') THEN ''
       WHEN event_type = 'click' THEN 'www.google.com'
       WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'old.reddit.com' ELSE 'news.example.net' END
       WHEN k % 3 = 0 THEN 'chatgpt.com' WHEN k % 3 = 1 THEN 'www.site1.example'
       ELSE 'Duckduckgo.com' END AS referer,
  '/p/' || (k % 25) AS path, 1::BIGINT AS views,
  (CASE WHEN event_type IN ('view', 'error', 'click') OR k % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS visits
  FROM ev WHERE user_id % 5 <> 0)""",
    """rum AS (SELECT event_id, ts, date, host, referer, path, views, visits,
  CASE WHEN host = 'site1.example' AND event_id % 3 = 0 THEN 'www.site1.example' ELSE host END AS raw_host
  FROM rum0)""",
    """zone_log AS (SELECT event_id, ts, date, 'files.example' AS host, 1::BIGINT AS requests,
  (CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS visits, floor(value * 1000)::BIGINT AS bytes,
  CASE WHEN event_type = 'error' AND k < 60 THEN 404 WHEN event_type = 'error' AND k < 75 THEN 503
       WHEN event_type = 'error' AND k < 80 THEN 406 WHEN dd = 30 AND event_type = 'signup' THEN 404
       WHEN event_type = 'view' AND k % 3 = 0 THEN 206 ELSE 200 END AS status,
  CASE k % 10 WHEN 0 THEN '/robots.txt' WHEN 1 THEN '/favicon.ico' WHEN 2 THEN '/cdn-cgi/trace'
       WHEN 3 THEN '/.well-known/x' WHEN 4 THEN '/sitemap_index.xml'
       ELSE '/books/' || k || '.pdf' END AS path,
  CASE WHEN k % 7 = 0 THEN '' ELSE 'C' || (user_id % 14) END AS country,
  CASE k % 6 WHEN 0 THEN 'AI Crawler' WHEN 1 THEN 'Archiver' WHEN 2 THEN 'Search Engine Crawler'
       ELSE '' END AS category
  FROM ev WHERE user_id % 5 = 0)""",
    """sites(host, measurement) AS (VALUES ('site0.example', 'rum'), ('site1.example', 'rum'),
  ('site2.example', 'rum'), ('wiki.example', 'rum'), ('files.example', 'zone'))""",
    """rum_daily AS (SELECT date, host, sum(visits)::BIGINT AS visits, sum(views)::BIGINT AS views
  FROM rum GROUP BY ALL)""",
    """zone_daily AS (SELECT date, host, sum(visits)::BIGINT AS visits, sum(requests)::BIGINT AS views,
  sum(bytes)::BIGINT AS bytes FROM zone_log GROUP BY ALL)""",
    """traffic AS (SELECT date, host, visits, views, 0::BIGINT AS bytes FROM rum_daily
  UNION ALL SELECT date, host, visits, views, bytes FROM zone_daily)""",
    f"""referrers AS (SELECT date, host, referrer, {kind_case("referrer",
        "referrer IN ('site1.example', 'www.site1.example') AND host = 'site1.example'")} AS kind, visits
  FROM (SELECT date, host, CASE WHEN referer = '' THEN '(direct)' ELSE referer END AS referrer,
        sum(visits)::BIGINT AS visits FROM rum WHERE visits > 0 GROUP BY ALL))""",
    """kinds AS (SELECT date, host, kind, sum(visits)::BIGINT AS visits FROM referrers GROUP BY ALL)""",
    """landing AS (SELECT date, host, path AS page, sum(visits)::BIGINT AS visits,
  sum(views)::BIGINT AS views FROM rum GROUP BY ALL)""",
    """zone_paths AS (SELECT date, host, path AS page, sum(requests)::BIGINT AS requests,
  sum(visits)::BIGINT AS zone_visits FROM zone_log GROUP BY ALL)""",
    "zone_pages AS (SELECT * FROM zone_paths)",
    """zone_countries AS (SELECT date, host, CASE WHEN country = '' THEN 'Unknown' ELSE country END
  AS country, sum(visits)::BIGINT AS visits FROM zone_log GROUP BY ALL)""",
    """zone_status AS (SELECT date, host, status::BIGINT AS status, sum(requests)::BIGINT AS requests
  FROM zone_log GROUP BY ALL)""",
    """zone_bots AS (SELECT date, host, CASE WHEN category = '' THEN '(unverified)' ELSE category END
  AS category, sum(requests)::BIGINT AS requests, sum(visits)::BIGINT AS visits
  FROM zone_log GROUP BY ALL)""",
    f"""keyword_rows AS (SELECT DATE '2024-01-30' AS date, {HOST_BY.format('l_partkey % 5')} AS host,
  'q' || l_partkey AS query, l_partkey, least(i, c)::BIGINT AS clicks, i::BIGINT AS impressions,
  round(1 + (l_partkey % 600) / 10.0::DOUBLE, 1) AS position, '2024-01-26–2024-01-28' AS search_window
  FROM (SELECT l_partkey, greatest(count(*) - 18, 0) + l_partkey % 9 AS i,
        count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity < 4) AS c
        FROM lineitem GROUP BY l_partkey))""",
    "keywords AS (SELECT * EXCLUDE l_partkey FROM keyword_rows)",
    "deny(host, pattern) AS (VALUES ('site0.example', '^q1'), ('wiki.example', '0$'))",
    """search_pages AS (SELECT date, host, 'https://' || host || '/r/' || (l_partkey % 200) AS page,
  sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions,
  round(CASE WHEN sum(impressions) <> 0 THEN sum(position * impressions) / sum(impressions) ELSE 0 END, 6)
    AS position, max(search_window) AS search_window,
  CASE WHEN sum(impressions) <> 0 THEN sum(clicks) / sum(impressions) ELSE 0 END AS ctr
  FROM keyword_rows GROUP BY 1, 2, 3)""",
    f"""search_summary AS (SELECT date, host, clicks, impressions, position,
  CASE WHEN impressions <> 0 THEN clicks / impressions ELSE 0 END AS ctr,
  {WINDOW.format('date')} AS search_window
  FROM (SELECT date, {HOST_BY.format('user_id % 5')} AS host,
        count(*) FILTER (WHERE event_type = 'click') AS clicks,
        sum(floor(value * 10))::BIGINT AS impressions, round(5 + avg(k) / 10, 6) AS position
        FROM ev GROUP BY 1, 2))""",
    """url_rows AS (SELECT page_id, url, regexp_extract(url, '(?i)^https?://([^/?#]+)([^?#]*)', 1) AS host,
  CASE WHEN page_id % 7 = 0 THEN p || '/%3C/span%3E8' WHEN page_id % 11 = 0 THEN '//dup' || page_id
       WHEN page_id % 13 = 0 THEN '/a/%zz' ELSE p END AS path
  FROM (SELECT *, regexp_extract(url, '(?i)^https?://([^/?#]+)([^?#]*)', 2) AS p FROM pages))""",
    """forum0 AS (SELECT date, 'forum' || (user_id % 2) || '.example' AS host,
  count(DISTINCT user_id) AS a, count(*) FILTER (WHERE event_type = 'signup') AS s,
  count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'purchase') AS t
  FROM ev GROUP BY 1, 2)""",
    """forum AS (SELECT date, host, (sum(s) OVER u)::BIGINT AS users_count, a AS active_today,
  (sum(a) OVER w7)::BIGINT AS active_7d, (sum(a) OVER w30)::BIGINT AS active_30d, s AS new_today,
  (sum(s) OVER w7)::BIGINT AS new_7d, (sum(s) OVER w30)::BIGINT AS new_30d, c AS posts_today,
  (sum(c) OVER u)::BIGINT AS posts_count, (sum(t) OVER u)::BIGINT AS topics_count FROM forum0
  WINDOW u AS (PARTITION BY host ORDER BY date ROWS UNBOUNDED PRECEDING),
   w7 AS (PARTITION BY host ORDER BY date ROWS 6 PRECEDING),
   w30 AS (PARTITION BY host ORDER BY date ROWS 29 PRECEDING))""",
]


def classified(min_visits: int = 20, direct: float = 0.6, multiple: float = 1.5,
               first: str = "2024-01-01", last: str = "2024-01-30") -> list[str]:
    """Classified and split days with the thresholds of the test tables."""
    return [
        f"""shape AS (SELECT t.date, t.host, t.visits, t.views, t.bytes, coalesce(d.visits, 0) AS direct,
  greatest(0, t.visits - coalesce(d.visits, 0)) AS non_direct,
  CASE WHEN t.visits <> 0 THEN t.views / t.visits ELSE 0 END AS pages_per_session,
  CASE WHEN t.visits <> 0 THEN coalesce(d.visits, 0) / t.visits ELSE 0 END AS direct_share
  FROM traffic t LEFT JOIN (SELECT * FROM kinds WHERE kind = 'direct') d USING (date, host)
  WHERE t.date BETWEEN DATE '{first}' AND DATE '{last}')""",
        f"""signed AS (SELECT *, visits > 0 AND pages_per_session > 0 AND pages_per_session <= 1.15
  AND direct_share >= {direct} AS signature FROM shape)""",
        """baselines AS (SELECT host, (CASE WHEN count(*) FILTER (WHERE NOT signature) >= 3
  THEN quantile_disc(visits, 0.5) FILTER (WHERE NOT signature)
  ELSE quantile_disc(visits, 0.25) END)::BIGINT AS baseline FROM signed GROUP BY host)""",
        f"""classified AS (SELECT *, signature AND visits >= {min_visits}
  AND visits >= greatest(baseline, 1) * {multiple} AS flood FROM signed JOIN baselines USING (host))""",
        """split AS (SELECT *, CASE WHEN flood THEN non_direct ELSE visits END AS human,
  CASE WHEN flood THEN visits - non_direct ELSE 0 END AS crawler,
  CASE WHEN flood THEN 0 ELSE views END AS human_views,
  CASE WHEN flood THEN views ELSE 0 END AS crawler_views, flood AS partial FROM classified)""",
        "floods AS (SELECT host, date FROM classified WHERE flood)",
    ]


def site_rows(days: int = 1, date: str = "2024-01-30") -> list[str]:
    """One row per configured site with both periods, and its rates."""

    def measures(prefix: str, rows: str) -> str:
        def s(column: str, condition: str = rows) -> str:
            return f"coalesce(sum({column}) FILTER (WHERE {condition}), 0)::BIGINT"

        part = f"{rows} AND partial"
        return ", ".join([
            f"{s('human')} AS {prefix}visits",
            f"{s('human_views')} AS {prefix}views",
            f"{s('human', part)} AS {prefix}partial_visits",
            f"count(*) FILTER (WHERE {part}) AS {prefix}partial_days",
            f"{s('crawler', part)} AS {prefix}bot_visits",
            f"{s('crawler_views', part)} AS {prefix}bot_views",
            f"count(*) FILTER (WHERE {part}) AS {prefix}bot_days",
            f"count(*) FILTER (WHERE {rows} AND NOT partial) AS {prefix}clean_days",
        ])

    d = f"DATE '{date}'"
    current = f"(date > {d} - {days} AND date <= {d})"
    previous = f"(date > {d} - {2 * days} AND date <= {d} - {days})"
    return [
        f"""st AS (SELECT s.host, s.measurement, {measures("", current)}, {measures("previous_", previous)},
  coalesce(sum(bytes) FILTER (WHERE {current}), 0)::BIGINT AS bytes
  FROM sites s LEFT JOIN split USING (host) GROUP BY s.host, s.measurement)""",
        """sr0 AS (SELECT *, CASE WHEN previous_visits <> 0 AND partial_days = 0 AND previous_partial_days = 0
    THEN (visits - previous_visits) / previous_visits END AS delta,
  CASE WHEN visits - partial_visits <> 0 THEN views / (visits - partial_visits) ELSE 0 END AS pages_per_session,
  CASE WHEN previous_visits - previous_partial_visits <> 0
    THEN previous_views / (previous_visits - previous_partial_visits) ELSE 0 END AS previous_pages_per_session
  FROM st)""",
        """sr AS (SELECT *, CASE WHEN previous_visits <> 0
    THEN pages_per_session - previous_pages_per_session END AS pages_per_session_delta FROM sr0)""",
        f"""refs AS (SELECT r.host, referrer, kind, sum(visits)::BIGINT AS visits FROM referrers r
  WHERE date > {d} - {days} AND date <= {d}
    AND (kind <> 'direct' OR (host, date) NOT IN (SELECT (host, date) FROM floods)) GROUP BY ALL)""",
        f"""land AS (SELECT host, page, sum(visits)::BIGINT AS visits, sum(views)::BIGINT AS views FROM landing
  WHERE date > {d} - {days} AND date <= {d}
    AND (host, date) NOT IN (SELECT (host, date) FROM floods) GROUP BY ALL)""",
        "land_card AS " + top("land", "host", "visits DESC, page", 8),
        "refs_card AS " + top("refs", "host", "visits DESC, referrer, kind", 8),
        """sources0 AS (SELECT st.host, st.measurement, st.visits,
  coalesce(sum(r.visits) FILTER (WHERE kind = 'direct'), 0)::BIGINT AS direct,
  coalesce(sum(r.visits) FILTER (WHERE kind = 'search'), 0)::BIGINT AS search,
  coalesce(sum(r.visits) FILTER (WHERE kind = 'social'), 0)::BIGINT AS social,
  coalesce(sum(r.visits) FILTER (WHERE kind IN ('ref', 'ai')), 0)::BIGINT AS referral,
  coalesce(sum(r.visits) FILTER (WHERE kind = 'internal'), 0)::BIGINT AS internal
  FROM st LEFT JOIN refs r USING (host) GROUP BY ALL)""",
        """sources AS (SELECT host, measurement, direct, search, social, referral, internal,
  greatest(0, visits - (direct + search + social + referral + internal))::BIGINT AS unattributed
  FROM sources0)""",
    ]


OPPORTUNITIES = [
    """allowed AS (SELECT k.* FROM keywords k WHERE NOT EXISTS (SELECT 1 FROM deny d
  WHERE d.host = k.host AND regexp_matches(k.query, '(?i)' || d.pattern)))""",
    f"""rated AS (SELECT *, CASE WHEN impressions <> 0 THEN clicks / impressions ELSE 0 END AS ctr,
  {ctr_case('position')} AS expected_ctr FROM allowed
  WHERE position > 0 AND impressions >= 5 AND position <= 50)""",
    f"""scored AS (SELECT *, CASE WHEN position <= 15 THEN 'snippet' ELSE 'rank' END AS kind,
  CASE WHEN position <= 15 THEN impressions * (expected_ctr - ctr)
       ELSE impressions * ({ctr_case('5.0::DOUBLE')}) - clicks END AS score FROM rated
  WHERE position > 15 OR ctr < expected_ctr * 0.5)""",
    """opps AS (SELECT *, CASE WHEN kind = 'snippet' THEN score END AS lost_clicks,
  CASE WHEN kind = 'rank' THEN score END AS potential_clicks FROM scored WHERE score >= 0.5)""",
]


def sql(body: str, *more: list[str]) -> str:
    ctes = [*BASE, *(cte for group in more for cte in group)]
    return "WITH " + ",\n".join(ctes) + "\n" + body


DATE = "strftime(date, '%Y-%m-%d') AS date"
