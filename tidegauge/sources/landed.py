"""Landed API responses, read with fixed schemas and flattened.

A response is one JSON document per line. The folder names below the given
paths carry what the response itself does not say: ``date=YYYY-MM-DD``, and
``host=`` (zone, search, forum), ``dimension=`` (zone) or ``account=`` (beacons; where
it is missing, each path is an account).

A response can be an error (a body with ``errors`` or ``error``, or a line that is no JSON
document of the source's shape). It gives no rows, and ``outcomes`` says so: rows alone
do not tell a pull that found nothing from one that failed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge import schemas as S
from tidegauge.functions.ranking import top_n
from tidegauge.functions.scalars import search_window, zero


#: Per source: its response, and the folder that tells whom a pull has asked.
SOURCES = {
    "beacons": (S.BEACON_RESPONSE, "account"),
    "zone": (S.ZONE_RESPONSE, "host"),
    "keywords": (S.SEARCH_RESPONSE, "host"),
    "search_pages": (S.SEARCH_RESPONSE, "host"),
    "search_summary": (S.SEARCH_RESPONSE, "host"),
    "forums": (S.FORUM_RESPONSE, "host"),
}
#: A zone host is pulled by several requests, one by each of these; a total of its own is optional.
ZONE_PARTS = ("path", "country", "status", "category")


def _responses(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """All responses with ``failure`` (null for a good one). One read per path, each with its
    own partition folders; accounts are few."""
    paths = [paths] if isinstance(paths, str) else paths
    failure = F.coalesce("error", "errors", F.concat(F.lit("unreadable: "), F.col("_corrupt_record")))
    parts = []
    for number, path in enumerate(paths, 1):
        read = spark.read.schema(f"{schema}, {S.RESPONSE_ERRORS}").json(path).withColumn("failure", failure)
        parts.append(read if "account" in read.columns else read.withColumn("account", F.lit(str(number))))
    return reduce(DataFrame.unionByName, parts)


def _json(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Good responses."""
    return _responses(spark, paths, schema).where(F.col("failure").isNull())


def outcomes(spark: SparkSession, source: str, paths: str | Sequence[str]) -> DataFrame:
    """(date, source, key, ok, message) of every pull: an account or host on a date.

    A pull is good if all its responses are (a retry replaces the file of the try before
    it); else the message is that of one of the others.
    """
    schema, key = SOURCES[source]
    # Counting the rows' own field makes the reader parse it: one of a wrong type is a broken line.
    body = schema.split()[0]
    failure = F.coalesce(F.min("failure"), F.when(F.count(body) < 0, F.lit("")))
    if source == "zone":
        left = F.array_except(F.array(*[F.lit(d) for d in ZONE_PARTS]), F.collect_set("dimension"))
        failure = F.coalesce(failure, F.when(F.size(left) > 0, F.concat(F.lit(f"{C.NO_RESPONSE} by "), F.array_join(left, ", "))))
    return (
        _responses(spark, paths, schema)
        .groupBy("date", F.lit(source).alias("source"), F.col(key).cast("string").alias("key"))
        .agg(failure.alias("message"))
        .select("date", "source", "key", F.col("message").isNull().cast("int").alias("ok"), "message")
    )


def settled(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Outcomes of all pulls that were ``expected`` (date, source, key) or made; one without
    any response has failed."""
    keys = ["date", "source", "key"]
    whole = found.join(expected.select(*keys).distinct(), keys, "full")
    return whole.select(
        *keys, F.coalesce("ok", F.lit(0)).alias("ok"),
        F.when(F.col("ok").isNull(), F.lit(C.NO_RESPONSE)).otherwise(F.col("message")).alias("message"),
    )


def read_beacons(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Beacon groups of every account, flat. Several paths are read as one source."""
    groups = F.get(F.col("data.viewer.accounts"), F.lit(0))["rumPageloadEventsAdaptiveGroups"]
    return (
        _json(spark, paths, S.BEACON_RESPONSE)
        .select("date", F.explode(groups).alias("g"))
        .select(
            "date",
            F.col("g.dimensions.requestHost").alias("raw_host"),
            F.col("g.dimensions.refererHost").alias("referer"),
            F.col("g.dimensions.requestPath").alias("path"),
            zero(F.col("g.count")).alias("views"),
            zero(F.col("g.sum.visits")).alias("visits"),
        )
    )


def read_zone(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Request-log groups by one dimension each: total, path, country, status, category."""
    groups = F.get(F.col("data.viewer.zones"), F.lit(0))["httpRequestsAdaptiveGroups"]
    return (
        _json(spark, paths, S.ZONE_RESPONSE)
        .select("date", "host", "dimension", F.explode(groups).alias("g"))
        .select(
            "date",
            "host",
            "dimension",
            F.col("g.dimensions.clientRequestPath").alias("path"),
            F.col("g.dimensions.clientCountryName").alias("country"),
            F.col("g.dimensions.edgeResponseStatus").alias("status"),
            F.col("g.dimensions.verifiedBotCategory").alias("category"),
            zero(F.col("g.count")).alias("requests"),
            zero(F.col("g.sum.visits")).alias("visits"),
            zero(F.col("g.sum.edgeResponseBytes")).alias("bytes"),
        )
    )


def _search_row(row: Column) -> list[Column]:
    return [
        zero(row["clicks"]).cast("long").alias("clicks"),
        zero(row["impressions"]).cast("long").alias("impressions"),
        zero(row["ctr"]).cast("double").alias("ctr"),
        zero(row["position"]).cast("double").alias("position"),
        search_window(F.col("date")).alias("search_window"),
    ]


def _read_search(spark: SparkSession, paths, key: str, limit: int | None) -> DataFrame:
    rows = (
        _json(spark, paths, S.SEARCH_RESPONSE)
        .select("date", "host", F.explode("rows").alias("r"))
        .select("date", "host", F.get("r.keys", F.lit(0)).alias(key), *_search_row(F.col("r")))
    )
    if limit is None:
        return rows
    order = [F.desc("clicks"), F.desc("impressions"), F.asc(key)]
    return top_n(rows, ["date", "host"], order, limit).drop("rank")


def read_keywords(spark: SparkSession, paths, limit: int | None = None) -> DataFrame:
    """Search rows by query, all of them or the first ``limit`` per site."""
    return _read_search(spark, paths, "query", limit)


def read_search_pages(spark: SparkSession, paths, limit: int | None = None) -> DataFrame:
    """Search rows by landing page, all of them or the first ``limit`` per site."""
    return _read_search(spark, paths, "page", limit)


def read_search_summary(spark: SparkSession, paths) -> DataFrame:
    """One whole-property row per site; zeros when the response has no row."""
    return (
        _json(spark, paths, S.SEARCH_RESPONSE)
        .select("date", "host", F.get("rows", F.lit(0)).alias("r"))
        .select("date", "host", *_search_row(F.col("r")))
    )


def read_forums(spark: SparkSession, paths) -> DataFrame:
    """Forum counters; a missing counter or a missing ``about.stats`` counts as zero."""
    stats = {
        "users_count": "users_count",
        "active_users_last_day": "active_today",
        "active_users_7_days": "active_7d",
        "active_users_30_days": "active_30d",
        "users_last_day": "new_today",
        "users_7_days": "new_7d",
        "users_30_days": "new_30d",
        "posts_last_day": "posts_today",
        "posts_count": "posts_count",
        "topics_count": "topics_count",
    }
    return _json(spark, paths, S.FORUM_RESPONSE).select(
        "date",
        "host",
        *[zero(F.col(f"about.stats.{name}")).alias(column) for name, column in stats.items()],
    )


def trailing_day(df: DataFrame, end: Column, ts: str = "ts") -> DataFrame:
    """Rows of the 24 hours up to and including ``end``."""
    return df.where(F.col(ts).between(end - F.expr("INTERVAL 24 HOURS"), end))


def cap_groups(
    df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str], n: int = C.SOURCE_GROUP_CAP
) -> DataFrame:
    """The source's own row cap: the ``n`` largest groups of each response."""
    return top_n(df, keys, [F.desc(by), *[F.asc(c) for c in ties]], n).drop("rank")


def filter_pages(df: DataFrame, page_filters: Mapping[str, str], page: str = "page") -> DataFrame:
    """Keep rows whose page URL matches the site's filter; sites without one keep all.

    Filters are configuration, so each is a literal pattern, which is compiled once.
    """
    if not page_filters:
        return df
    by_pattern: dict[str, list[str]] = {}
    for host, pattern in page_filters.items():
        by_pattern.setdefault(pattern, []).append(host)
    matches = [F.col("host").isin(hosts) & F.col(page).rlike(p) for p, hosts in by_pattern.items()]
    free = F.col("host").isNull() | ~F.col("host").isin(list(page_filters))
    return df.where(reduce(Column.__or__, matches, free))
