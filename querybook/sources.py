"""A: sources, and D: scalar functions."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querybook.registry import query
from querybook.sql import DATE, NON_CONTENT, ctr_case, kind_case, malformed, sql, top
from querybook.views import CONFIG, Views
from tidegauge.functions import scalars as D
from tidegauge.functions import text
from tidegauge.operators import ingest as B
from tidegauge.operators import opportunities as O
from tidegauge.sinks import daily
from tidegauge.sinks.scratch import new_folder
from tidegauge.sources import landed as A
from tidegauge.sources import tables as stored

# Groups per written response; keeps the array of one response small.
PER_RESPONSE = 2000


def land_beacons(v: Views, accounts: int = 1) -> list[str]:
    """Write beacon rows the way the API answers: nested, one folder per account."""
    group = F.struct(
        F.col("views").alias("count"),
        F.struct("visits").alias("sum"),
        F.struct(
            F.col("referer").alias("refererHost"),
            F.col("raw_host").alias("requestHost"),
            F.col("path").alias("requestPath"),
        ).alias("dimensions"),
    )
    response = F.struct(
        F.struct(
            F.array(F.struct(F.col("groups").alias("rumPageloadEventsAdaptiveGroups"))).alias("accounts")
        ).alias("viewer")
    )
    folder = new_folder(v.spark, "beacons")
    (
        v.beacons.groupBy(
            "date",
            (F.col("event_id") % accounts).alias("account"),
            F.floor(F.col("event_id") / PER_RESPONSE).alias("page"),
        )
        .agg(F.collect_list(group).alias("groups"))
        .select("account", "date", response.alias("data"))
        .write.partitionBy("account", "date")
        .json(folder)
    )
    return [f"{folder}/account={n}" for n in range(accounts)]


BEACON_COLUMNS = "raw_host, referer, path, views, visits"
FLAT_BEACONS = sql(f"SELECT {DATE}, {BEACON_COLUMNS} FROM rum")


@query("a1_rum_scan", FLAT_BEACONS)
def _(v):
    return A.read_beacons(v.spark, land_beacons(v))


@query("a2_account_union", FLAT_BEACONS)
def _(v):
    return A.read_beacons(v.spark, land_beacons(v, accounts=4))


@query("a3_window_filter", sql(
    "SELECT event_id, host, path FROM rum"
    " WHERE ts BETWEEN TIMESTAMP '2024-01-29 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00'"))
def _(v):
    end = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return A.trailing_day(v.rum, end).select("event_id", "host", "path")


@query("a4_ranked_cap", sql(
    f"SELECT {DATE}, host, referer, path, count, visits FROM "
    + top("(SELECT date, host, referer, path, sum(views)::BIGINT AS count, sum(visits)::BIGINT AS visits"
          " FROM rum GROUP BY ALL)", "date", "count DESC, host, referer, path", 100)))
def _(v):
    groups = v.rum.groupBy("date", "host", "referer", "path").agg(
        F.sum("views").alias("count"), F.sum("visits").alias("visits")
    )
    return A.cap_groups(groups, ["date"], "count", ["host", "referer", "path"], 100)


def land_zone(v: Views) -> str:
    """Write the request log as the API answers: one folder per dimension."""
    totals = B.zone_traffic(v.zone_rollup).withColumnRenamed("views", "requests")
    rolled = v.zone_rollup.unionByName(
        totals.withColumn("section", F.lit("traffic")), allowMissingColumns=True
    )
    names = {"traffic": "total", "zone_pages": "path", "zone_countries": "country",
             "zone_status": "status", "zone_bots": "category"}
    group = F.struct(
        F.col("requests").alias("count"),
        F.struct("visits", F.col("bytes").alias("edgeResponseBytes")).alias("sum"),
        F.struct(
            F.col("page").alias("clientRequestPath"),
            F.col("country").alias("clientCountryName"),
            F.col("status").alias("edgeResponseStatus"),
            F.col("category").alias("verifiedBotCategory"),
        ).alias("dimensions"),
    )
    response = F.struct(
        F.struct(
            F.array(F.struct(F.array(group).alias("httpRequestsAdaptiveGroups"))).alias("zones")
        ).alias("viewer")
    )
    dimension = D.reduce(
        lambda chain, item: chain.when(F.col("section") == item[0], item[1]),
        names.items(), F.when(F.lit(False), ""),
    )
    folder = new_folder(v.spark, "zone")
    (
        rolled.select("date", "host", dimension.alias("dimension"), response.alias("data"))
        .write.partitionBy("date", "host", "dimension")
        .json(folder)
    )
    return folder


@query("a5_zone_scan", sql(f"""SELECT strftime(date, '%Y-%m-%d') AS date, host, dimension, value, requests, visits, bytes FROM (
  SELECT date, host, 'total' AS dimension, NULL AS value, sum(requests)::BIGINT AS requests,
    sum(visits)::BIGINT AS visits, sum(bytes)::BIGINT AS bytes FROM zone_log GROUP BY date, host
  UNION ALL SELECT date, host, 'path', path, sum(requests)::BIGINT, sum(visits)::BIGINT, sum(bytes)::BIGINT
    FROM zone_log GROUP BY date, host, path
  UNION ALL SELECT date, host, 'country', coalesce(nullif(country, ''), 'Unknown'), sum(requests)::BIGINT,
    sum(visits)::BIGINT, sum(bytes)::BIGINT FROM zone_log GROUP BY date, host, country
  UNION ALL SELECT date, host, 'status', status::VARCHAR, sum(requests)::BIGINT, sum(visits)::BIGINT,
    sum(bytes)::BIGINT FROM zone_log GROUP BY date, host, status
  UNION ALL SELECT date, host, 'category', coalesce(nullif(category, ''), '(unverified)'),
    sum(requests)::BIGINT, sum(visits)::BIGINT, sum(bytes)::BIGINT FROM zone_log GROUP BY date, host, category)"""))
def _(v):
    value = F.coalesce("path", "country", F.col("status").cast("string"), "category")
    return A.read_zone(v.spark, land_zone(v)).select(
        "date", "host", "dimension", value.alias("value"), "requests", "visits", "bytes"
    )


def land_search(v: Views, rows: DataFrame, key: str | None) -> str:
    keys = F.array(key) if key else F.array().cast("array<string>")
    row = F.struct(keys.alias("keys"), "clicks", "impressions", "ctr", "position")
    folder = new_folder(v.spark, "search")
    (
        rows.select("date", "host", F.array(row).alias("rows"))
        .write.partitionBy("date", "host")
        .json(folder)
    )
    return folder


def _with_ctr(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ctr", D.ratio(F.col("clicks"), F.col("impressions")))


CTR = "round(CASE WHEN impressions <> 0 THEN clicks / impressions ELSE 0 END, 6) AS ctr"


@query("a6_keyword_scan", sql(
    f"SELECT {DATE}, host, query, clicks, impressions, {CTR}, position, search_window FROM keywords"))
def _(v):
    return A.read_keywords(v.spark, land_search(v, _with_ctr(v.keywords), "query"))


@query("a7_search_page_scan", sql(
    f"SELECT {DATE}, host, page, clicks, impressions, {CTR}, round(position, 6) AS position, search_window"
    " FROM search_pages"))
def _(v):
    return A.read_search_pages(v.spark, land_search(v, v.search_pages, "page"))


@query("a8_search_summary_scan", sql(
    f"SELECT {DATE}, host, clicks, impressions, {CTR}, round(position, 6) AS position, search_window"
    " FROM search_summary"))
def _(v):
    return A.read_search_summary(v.spark, land_search(v, v.search_summary, None))


@query("a9_page_url_filter", sql(
    "SELECT host, page, clicks, impressions FROM search_pages"
    " WHERE host <> 'site1.example' OR regexp_matches(page, '^https://site1\\.example/r/1')"))
def _(v):
    kept = A.filter_pages(v.search_pages, CONFIG.page_filters())
    return kept.select("host", "page", "clicks", "impressions")


FORUM_COLUMNS = (
    "users_count, active_today, active_7d, active_30d, new_today, new_7d, new_30d,"
    " posts_today, posts_count, topics_count"
)


@query("a10_forum_scan", sql(f"SELECT {DATE}, host, {FORUM_COLUMNS} FROM forum"))
def _(v):
    names = {"users_count": "users_count", "active_users_last_day": "active_today",
             "active_users_7_days": "active_7d", "active_users_30_days": "active_30d",
             "users_last_day": "new_today", "users_7_days": "new_7d", "users_30_days": "new_30d",
             "posts_last_day": "posts_today", "posts_count": "posts_count", "topics_count": "topics_count"}
    stats = F.struct(*[F.col(column).alias(name) for name, column in names.items()])
    folder = new_folder(v.spark, "forums")
    (
        v.forum.select("date", "host", F.struct(stats.alias("stats")).alias("about"))
        .write.partitionBy("date", "host")
        .json(folder)
    )
    return A.read_forums(v.spark, folder)


@query("a11_table_or_empty", sql(
    "SELECT host, sum(requests)::BIGINT AS requests, true AS statuses_measured, false AS bots_measured"
    " FROM zone_status GROUP BY host"))
def _(v):
    root = new_folder(v.spark, "tables")
    rows = v.tables["zone_status"]
    daily.replace_scope(v.spark, root, "zone_status", rows, rows.select("date", "host"))
    statuses, has_statuses = stored.stored(v.spark, root, "zone_status")
    bots, has_bots = stored.stored(v.spark, root, "zone_bots")
    extra = bots.select("host", "requests")
    return (
        statuses.select("host", "requests").unionByName(extra)
        .groupBy("host")
        .agg(F.sum("requests").alias("requests"))
        .withColumn("statuses_measured", F.lit(has_statuses))
        .withColumn("bots_measured", F.lit(has_bots))
    )


@query("a12_latest_run", sql(
    "SELECT strftime(date + INTERVAL 13 HOUR, '%Y-%m-%d %H:%M:%S') AS run_at, strftime(date, '%Y-%m-%d') AS date,"
    " CASE WHEN n > 0 THEN 1 ELSE 0 END::BIGINT AS ok, 'rows ' || n AS note FROM (SELECT date, count(*) AS n FROM ev GROUP BY date)"
    " ORDER BY run_at DESC LIMIT 1"))
def _(v):
    runs = v.events.groupBy("date").agg(F.count("*").alias("n")).select(
        (F.col("date").cast("timestamp") + F.expr("INTERVAL 13 HOURS")).alias("run_at"),
        "date",
        (F.col("n") > 0).cast("int").alias("ok"),
        F.concat(F.lit("rows "), "n").alias("note"),
    )
    return stored.latest_run(runs)


@query("a13_latest_date", sql("SELECT strftime(max(date), '%Y-%m-%d') AS date FROM traffic"))
def _(v):
    return stored.latest_date(v.tables["traffic"])


# ------------------------------------------------------------ scalar functions

@query("d1_referrer_kind", sql(f"""SELECT r AS referrer, host, kind, count(*) AS n FROM (
  SELECT referer AS r, host, {kind_case("referer",
      "referer IN ('site1.example', 'www.site1.example') AND host = 'site1.example'")} AS kind FROM rum
  UNION ALL SELECT host, 'site1.example', {kind_case("host",
      "host IN ('site1.example', 'www.site1.example')")} FROM url_rows)
  GROUP BY ALL"""))
def _(v):
    seen = v.rum.select(F.col("referer").alias("referrer"), "host").unionByName(
        v.url_rows.select(F.col("host").alias("referrer"), F.lit("site1.example").alias("host"))
    )
    counted = seen.groupBy("referrer", "host").agg(F.count("*").alias("n"))
    return B.with_kind(counted, CONFIG.aliases_df(v.spark))


@query("d2_dates", sql(
    "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS later,"
    " strftime(ts - INTERVAL 40 DAY, '%Y-%m-%d') AS earlier FROM ev"))
def _(v):
    date = F.to_date("ts")
    return v.events.select(
        date.alias("date"), F.date_add(date, 3).alias("later"), F.date_sub(date, 40).alias("earlier")
    ).distinct()


@query("d3_non_content_path", sql(
    f"SELECT DISTINCT path, {NON_CONTENT.format('path')} AS non_content FROM"
    " (SELECT path FROM zone_log UNION ALL SELECT path FROM url_rows UNION ALL SELECT '/books' || path FROM zone_log)"))
def _(v):
    paths = v.zone_log.select("path").unionByName(v.url_rows.select("path")).unionByName(
        v.zone_log.select(F.concat(F.lit("/books"), "path").alias("path"))
    )
    return paths.distinct().select("path", D.is_non_content(F.col("path")).alias("non_content"))


@query("d4_malformed_url", sql(f"SELECT page_id, path, {malformed('path')} AS malformed FROM url_rows"))
def _(v):
    return v.url_rows.select("page_id", "path", D.is_malformed(F.col("path")).alias("malformed"))


@query("d5_expected_ctr", sql(
    f"SELECT query, position, round({ctr_case('position')}, 6) AS expected, round({ctr_case('(position * 3)')}, 6)"
    " AS expected_deep FROM keywords"))
def _(v):
    position = F.col("position")
    return v.keywords.select(
        "query", "position", D.expected_ctr(position).alias("expected"),
        D.expected_ctr(position * 3).alias("expected_deep"),
    )


@query("d6_denied_query", sql(
    "SELECT k.host, query FROM keywords k WHERE EXISTS (SELECT 1 FROM deny d"
    " WHERE d.host = k.host AND regexp_matches(k.query, '(?i)' || d.pattern))"))
def _(v):
    marked = O.mark_denied(v.keywords.select("host", "query"), CONFIG.deny(v.spark))
    return marked.where("denied").drop("denied")


@query("d7_anchor", sql(
    "SELECT DISTINCT host, 'site-' || regexp_replace(host, '[^a-zA-Z0-9]', '-', 'g') AS anchor FROM url_rows"))
def _(v):
    return v.url_rows.select("host", D.anchor(F.col("host")).alias("anchor")).distinct()


@query("d8_number_text", sql(
    "SELECT date, host, regexp_replace(printf('%,d', impressions), '_', ',') AS impressions_text,"
    " CAST(round(clicks * 100.0 / impressions) AS BIGINT) || '%' AS ctr_text FROM"
    " (SELECT strftime(date, '%Y-%m-%d') AS date, host, clicks, impressions FROM search_summary WHERE impressions > 0)"))
def _(v):
    rows = v.search_summary.where(F.col("impressions") > 0)
    return rows.select(
        "date", "host", F.expr(text.number("impressions")).alias("impressions_text"),
        F.expr(text.percent("clicks / impressions")).alias("ctr_text"),
    )


@query("d9_bytes_text", sql("""SELECT strftime(date, '%Y-%m-%d') AS date, unit, bytes, CASE unit WHEN 'B' THEN bytes || ' B'
  ELSE printf('%.1f', bytes / pow(1024, list_position(['KB', 'MB', 'GB', 'TB'], unit))) || ' ' || unit END AS label
  FROM (SELECT *, CASE WHEN bytes < 1024 THEN 'B' WHEN bytes < 1024 ** 2 THEN 'KB' WHEN bytes < 1024 ** 3 THEN 'MB'
    WHEN bytes < 1024 ** 4 THEN 'GB' ELSE 'TB' END AS unit FROM
    (SELECT date, sum(bytes)::BIGINT AS bytes FROM zone_log GROUP BY date
     UNION ALL SELECT date, (sum(bytes) * 1000000)::BIGINT FROM zone_log GROUP BY date
     UNION ALL SELECT date, count(*) FROM zone_log GROUP BY date))"""))
def _(v):
    daily_bytes = v.zone_log.groupBy("date").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    sizes = daily_bytes.select("date", F.explode(F.array("b", F.col("b") * 1000000, "n")).alias("bytes"))
    label = F.expr(text.byte_size("bytes"))
    return sizes.select("date", F.element_at(F.split(label, " "), 2).alias("unit"), "bytes", label.alias("label"))


@query("d10_page_label", sql(
    "SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END || q AS label, path AS bare FROM"
    " (SELECT page_id, path, regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1) AS p,"
    " regexp_extract(url, '^[^?#]*(\\?[^#]+)', 1) AS q FROM url_rows)"))
def _(v):
    return v.url_rows.select(
        "page_id", D.page_label(F.col("url")).alias("label"), D.page_label(F.col("path")).alias("bare")
    )


@query("d11_labels", sql(
    "SELECT DISTINCT referrer, kind, CASE WHEN referrer = '(direct)' THEN 'Direct / none' ELSE referrer END AS label,"
    " CASE kind WHEN 'ref' THEN 'referral' WHEN 'ai' THEN 'AI' ELSE kind END AS tag FROM referrers"))
def _(v):
    rows = v.tables["referrers"].select("referrer", "kind").distinct()
    return rows.select(
        "referrer", "kind", D.referrer_label(F.col("referrer")).alias("label"),
        D.kind_label(F.col("kind")).alias("tag"),
    )


@query("d12_delta_badge", sql("""SELECT strftime(date, '%Y-%m-%d') AS date, host, CASE WHEN delta IS NULL THEN 'none'
    WHEN abs(change) < 25 THEN 'small' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'neutral' END AS class,
  CASE WHEN delta IS NULL THEN 'no comparison' WHEN abs(change) < 25 THEN
    (CASE WHEN change > 0 THEN '+' WHEN change < 0 THEN '−' ELSE '±' END) || abs(change) || ' vs previous' ELSE 'percentage' END AS label
  FROM (SELECT date, host, visits - p AS change, CASE WHEN p <> 0 THEN (visits - p) / p END AS delta
    FROM (SELECT t.date, t.host, t.visits, coalesce(y.visits, 0) AS p FROM traffic t LEFT JOIN traffic y
      ON y.host = t.host AND y.date = t.date - 1))"""))
def _(v):
    t = v.tables["traffic"].select("date", "host", "visits")
    before = t.select(F.date_add("date", 1).alias("date"), "host", F.col("visits").alias("p"))
    change = F.col("visits") - F.col("p")
    rows = t.join(before, ["date", "host"], "left").fillna(0, ["p"]).select(
        "date", "host", change.alias("change"), F.when(F.col("p") != 0, change / F.col("p")).alias("delta")
    )
    delta, moved = F.col("delta"), F.col("change")
    label = F.expr(text.delta_label("delta", "change"))
    return rows.select(
        "date", "host", D.delta_class(delta, moved).alias("class"),
        F.when(label.contains("%"), "percentage").otherwise(label).alias("label"),
    )


@query("d13_strip_www", sql(
    "SELECT DISTINCT raw_host, regexp_replace(raw_host, '^www\\.', '') AS short FROM rum"))
def _(v):
    return v.rum.select("raw_host", D.strip_www(F.col("raw_host")).alias("short")).distinct()


@query("d14_display_dates", sql(
    "SELECT strftime(date, '%Y-%m-%d') AS date, strftime(date, '%b %-d, %Y') AS label, "
    "strftime(first_ts - INTERVAL 7 HOUR, '%b %-d, %-I:%M %p') || ' MST' AS seen FROM (SELECT date, min(ts) AS first_ts FROM ev GROUP BY date)"))
def _(v):
    first = v.events.groupBy("date").agg(F.min("ts").cast("timestamp").alias("seen"))
    return first.select("date", D.date_label(F.col("date")).alias("label"), D.timestamp_label(F.col("seen")).alias("seen"))


@query("d15_null_safe", sql(
    "SELECT query, impressions, clicks, round(CASE WHEN impressions <> 0 THEN clicks / impressions ELSE 0 END, 6) AS ctr,"
    " coalesce(nullif(clicks, 0), 0) AS filled FROM keywords"))
def _(v):
    clicks, impressions = F.col("clicks"), F.col("impressions")
    return v.keywords.select(
        "query", "impressions", "clicks", D.ratio(clicks, impressions).alias("ctr"),
        D.zero(F.nullif(clicks, F.lit(0))).alias("filled"),
    )
