"""Explicit schemas: stored daily tables, site config and landed API responses."""

from pyspark.sql import types as T


_TYPES = {
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "STRING": T.StringType(),
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(),
}


def _table(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Stored daily tables. Zone pages carry honest names (requests, zone_visits): a
# request log counts requests, never sessions.
TABLES = {
    "traffic": _table("date DATE, host STRING, visits BIGINT, views BIGINT, bytes BIGINT"),
    "referrers": _table("date DATE, host STRING, referrer STRING, kind STRING, visits BIGINT"),
    "landing": _table("date DATE, host STRING, page STRING, visits BIGINT, views BIGINT"),
    "zone_pages": _table("date DATE, host STRING, page STRING, requests BIGINT, zone_visits BIGINT"),
    "zone_countries": _table("date DATE, host STRING, country STRING, visits BIGINT"),
    "zone_status": _table("date DATE, host STRING, status INT, requests BIGINT"),
    "zone_bots": _table("date DATE, host STRING, category STRING, requests BIGINT, visits BIGINT"),
    "keywords": _table(
        "date DATE, host STRING, query STRING, clicks BIGINT, impressions BIGINT,"
        " position DOUBLE, search_window STRING"
    ),
    "search_pages": _table(
        "date DATE, host STRING, page STRING, clicks BIGINT, impressions BIGINT,"
        " ctr DOUBLE, position DOUBLE, search_window STRING"
    ),
    "search_summary": _table(
        "date DATE, host STRING, clicks BIGINT, impressions BIGINT, ctr DOUBLE,"
        " position DOUBLE, search_window STRING"
    ),
    "forums": _table(
        "date DATE, host STRING, users_count BIGINT, active_today BIGINT, active_7d BIGINT,"
        " active_30d BIGINT, new_today BIGINT, new_7d BIGINT, new_30d BIGINT,"
        " posts_today BIGINT, posts_count BIGINT, topics_count BIGINT"
    ),
    "runs": _table("run_at TIMESTAMP, date DATE, ok INT, note STRING"),
    # Signals of each report date, with how many days in a row they had fired before.
    "signals": _table(
        "date DATE, host STRING, kind STRING, severity INT, weight DOUBLE, headline STRING,"
        " evidence STRING, action STRING, recurrence INT"
    ),
    # What became of each pull: its source, and the account or host that it asked for.
    "pulls": _table("date DATE, source STRING, key STRING, ok INT, message STRING"),
}

# Value for a column that an older file does not have (additive evolution).
# Columns without an entry stay NULL: the NULL means "not measured".
DEFAULTS = {
    "traffic": {"visits": 0, "views": 0, "bytes": 0},
    "referrers": {"kind": "ref", "visits": 0},
    "landing": {"visits": 0, "views": 0},
    "zone_pages": {"requests": 0, "zone_visits": 0},
    "zone_countries": {"visits": 0},
    "zone_status": {"requests": 0},
    "zone_bots": {"requests": 0, "visits": 0},
    "keywords": {"clicks": 0, "impressions": 0, "position": 0.0},
    "search_pages": {"clicks": 0, "impressions": 0, "position": 0.0},
    "search_summary": {"clicks": 0, "impressions": 0, "ctr": 0.0, "position": 0.0},
    "forums": {
        name: 0 for name in TABLES["forums"].fieldNames() if name not in ("date", "host")
    },
    "runs": {},
    "pulls": {},
    "signals": {},
}

KEYS = {
    "traffic": ("date", "host"),
    "referrers": ("date", "host", "referrer"),
    "landing": ("date", "host", "page"),
    "zone_pages": ("date", "host", "page"),
    "zone_countries": ("date", "host", "country"),
    "zone_status": ("date", "host", "status"),
    "zone_bots": ("date", "host", "category"),
    "keywords": ("date", "host", "query"),
    "search_pages": ("date", "host", "page"),
    "search_summary": ("date", "host"),
    "forums": ("date", "host"),
    "runs": ("run_at",),
    "pulls": ("date", "source", "key"),
    "signals": ("date", "host", "kind"),
}

# Landed responses, one JSON document per line, below date=YYYY-MM-DD folders. What a
# source says instead of rows is kept as it is written, whatever its shape.
RESPONSE_ERRORS = "errors STRING, error STRING, _corrupt_record STRING"
BEACON_RESPONSE = (
    "data STRUCT<viewer: STRUCT<accounts: ARRAY<STRUCT<rumPageloadEventsAdaptiveGroups:"
    " ARRAY<STRUCT<count: BIGINT, sum: STRUCT<visits: BIGINT>, dimensions:"
    " STRUCT<refererHost: STRING, requestHost: STRING, requestPath: STRING>>>>>>>"
)
ZONE_RESPONSE = (
    "data STRUCT<viewer: STRUCT<zones: ARRAY<STRUCT<httpRequestsAdaptiveGroups:"
    " ARRAY<STRUCT<count: BIGINT, sum: STRUCT<visits: BIGINT, edgeResponseBytes: BIGINT>,"
    " dimensions: STRUCT<clientRequestPath: STRING, clientCountryName: STRING,"
    " edgeResponseStatus: INT, verifiedBotCategory: STRING>>>>>>>"
)
SEARCH_RESPONSE = (
    "rows ARRAY<STRUCT<keys: ARRAY<STRING>, clicks: DOUBLE, impressions: DOUBLE,"
    " ctr: DOUBLE, position: DOUBLE>>"
)
FORUM_RESPONSE = (
    "about STRUCT<stats: STRUCT<users_count: BIGINT, active_users_last_day: BIGINT,"
    " active_users_7_days: BIGINT, active_users_30_days: BIGINT, users_last_day: BIGINT,"
    " users_7_days: BIGINT, users_30_days: BIGINT, posts_last_day: BIGINT,"
    " posts_count: BIGINT, topics_count: BIGINT>>"
)

SIGNAL_COLUMNS = (
    "severity", "kind", "host", "headline", "evidence", "action", "href", "recurrence", "weight",
)
