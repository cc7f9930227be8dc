"""From beacon groups and request-log rows to daily per-site tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.functions.ranking import top_n
from tidegauge.functions.scalars import named, referrer_kind, zero

DAY = ["date", "host"]


def resolve_hosts(beacons: DataFrame, aliases: DataFrame) -> DataFrame:
    """Map every host name to its site's primary host; unknown hosts are dropped."""
    return beacons.join(aliases, F.col("raw_host") == F.col("alias")).drop("alias")


def drop_excluded(beacons: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop the (host, path) pairs that a site does not count."""
    return beacons.join(excluded, ["host", "path"], "left_anti")


def _named_beacons(beacons: DataFrame) -> DataFrame:
    return beacons.select(
        *DAY,
        named(F.col("referer"), C.DIRECT_REFERRER).alias("referrer"),
        named(F.col("path"), C.ROOT_PATH).alias("page"),
        "views",
        "visits",
    )


def host_daily_traffic(beacons: DataFrame) -> DataFrame:
    return beacons.groupBy(*DAY).agg(
        F.sum("visits").alias("visits"), F.sum("views").alias("views")
    )


def referrer_daily(beacons: DataFrame) -> DataFrame:
    """Sessions by referrer; groups that start no session have no row."""
    return (
        _named_beacons(beacons.where(F.col("visits") > 0))
        .groupBy(*DAY, "referrer")
        .agg(F.sum("visits").alias("visits"))
    )


def landing_daily(beacons: DataFrame) -> DataFrame:
    """Views and sessions by landing page; pages without a session stay."""
    return (
        _named_beacons(beacons)
        .groupBy(*DAY, "page")
        .agg(F.sum("visits").alias("visits"), F.sum("views").alias("views"))
    )


def beacon_rollup(beacons: DataFrame) -> DataFrame:
    """The referrer and the landing rollup in one read of the source.

    Grouping sets keep the source scan single; each section is combined inside
    the tasks before the one shuffle. Totals need no set of their own: every
    beacon row has a page, so :func:`beacon_traffic` adds the landing rows up.
    Use :func:`section` to take a section out.
    """
    df = _named_beacons(beacons)
    sets = [[F.col(c) for c in [*DAY, name]] for name in ("referrer", "page")]
    rolled = df.groupingSets(sets, *DAY, "referrer", "page").agg(
        F.sum("visits").alias("visits"),
        F.sum("views").alias("views"),
        F.max(F.col("visits") > 0).alias("referred"),
    )
    by_page = F.col("referrer").isNull()
    return (
        rolled.withColumn("section", F.when(by_page, "landing").otherwise("referrers"))
        .where(by_page | F.col("referred"))
        .drop("referred")
    )


def beacon_traffic(rollup: DataFrame) -> DataFrame:
    return host_daily_traffic(rollup.where(F.col("section") == "landing"))


def zone_rollup(log: DataFrame) -> DataFrame:
    """Four single-dimension rollups of request-log rows, in one read.

    Empty dimension values are named before grouping, so that a NULL in the
    result can only mean "not grouped by this column". Totals are added up from
    the status section, the smallest one that holds every request.
    """
    df = log.select(
        *DAY,
        named(F.col("path"), C.ROOT_PATH).alias("page"),
        named(F.col("country"), C.UNKNOWN_COUNTRY).alias("country"),
        F.coalesce("status", F.lit(0)).alias("status"),
        named(F.col("category"), C.UNVERIFIED_CATEGORY).alias("category"),
        "requests",
        "visits",
        "bytes",
    )
    sections = {
        "page": "zone_pages", "country": "zone_countries",
        "status": "zone_status", "category": "zone_bots",
    }
    rolled = df.groupingSets(
        [[F.col(c) for c in [*DAY, name]] for name in sections], *DAY, *sections
    ).agg(
        F.sum("requests").alias("requests"),
        F.sum("visits").alias("visits"),
        F.sum("bytes").alias("bytes"),
    )
    return rolled.withColumn(
        "section",
        F.coalesce(*[F.when(F.col(c).isNotNull(), table) for c, table in sections.items()]),
    )


ZONE_DIMENSIONS = {
    "total": "zone_total", "path": "zone_pages", "country": "zone_countries",
    "status": "zone_status", "category": "zone_bots",
}


def zone_rollup_from_groups(groups: DataFrame) -> DataFrame:
    """The same sections from groups by one dimension each.

    Every dimension counts all requests again, so a group belongs to the section of
    its own dimension only; totals have groups of their own. Values that are equal
    once named (an empty and a missing one) are added up.
    """

    def of(dimension: str, value) -> Column:
        return F.when(F.col("dimension") == dimension, value)

    names = F.create_map(*[F.lit(x) for pair in ZONE_DIMENSIONS.items() for x in pair])
    rows = groups.where(F.col("dimension").isin(list(ZONE_DIMENSIONS))).select(
        *DAY,
        of("path", named(F.col("path"), C.ROOT_PATH)).alias("page"),
        of("country", named(F.col("country"), C.UNKNOWN_COUNTRY)).alias("country"),
        of("status", F.coalesce("status", F.lit(0))).alias("status"),
        of("category", named(F.col("category"), C.UNVERIFIED_CATEGORY)).alias("category"),
        "requests", "visits", "bytes",
        names[F.col("dimension")].alias("section"),
    )
    keys = ["page", "country", "status", "category", "section"]
    return rows.groupBy(*DAY, *keys).agg(*[F.sum(c).alias(c) for c in ("requests", "visits", "bytes")])


def section(rollup: DataFrame, name: str, *columns: str) -> DataFrame:
    """One section of a rollup with its own columns."""
    return rollup.where(F.col("section") == name).select(*DAY, *columns)


def zone_traffic(rollup: DataFrame) -> DataFrame:
    """Daily totals of zone hosts; ``views`` holds the request count.

    Where a day has no total of its own, its statuses are added up.
    """

    def total(measure: str) -> Column:
        own = F.sum(F.when(F.col("section") == "zone_total", F.col(measure)))
        return F.coalesce(own, F.sum(F.when(F.col("section") == "zone_status", F.col(measure))))

    return (
        rollup.where(F.col("section").isin("zone_total", "zone_status"))
        .groupBy(*DAY)
        .agg(total("visits").alias("visits"), total("requests").alias("views"), total("bytes").alias("bytes"))
    )


def zone_paths(rollup: DataFrame) -> DataFrame:
    """Requests by path, all of them."""
    pages = section(rollup, "zone_pages", "page", "requests", "visits")
    return pages.withColumnRenamed("visits", "zone_visits")


def zone_top_paths(rollup: DataFrame, n: int = C.STORED_ZONE_PATHS) -> DataFrame:
    """Most requested paths: for a file host, "top" means most hit."""
    return top_n(zone_paths(rollup), DAY, [F.desc("requests"), F.asc("page")], n)


def zone_top_countries(rollup: DataFrame, n: int = C.STORED_ZONE_COUNTRIES) -> DataFrame:
    rows = section(rollup, "zone_countries", "country", "visits")
    return top_n(rows, DAY, [F.desc("visits"), F.asc("country")], n)


def zone_top_statuses(rollup: DataFrame, n: int = C.STORED_ZONE_STATUSES) -> DataFrame:
    rows = section(rollup, "zone_status", "status", "requests")
    return top_n(rows, DAY, [F.desc("requests"), F.asc("status")], n)


def zone_bot_rows(rollup: DataFrame) -> DataFrame:
    """Every crawler category, never cut, most requests first."""
    return section(rollup, "zone_bots", "category", "requests", "visits").orderBy(
        "date", "host", F.desc("requests"), "category"
    )


def with_kind(referrers: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Add the channel; a referrer that is one of the site's own hosts is internal."""
    if aliases is None:
        return referrers.withColumn("kind", referrer_kind(F.col("referrer")))
    own = aliases.select(F.col("alias").alias("referrer"), "host", F.lit(True).alias("own"))
    joined = referrers.join(own, ["host", "referrer"], "left")
    return joined.withColumn(
        "kind", referrer_kind(F.col("referrer"), F.col("own").isNotNull())
    ).drop("own")


def top_referrers(
    referrers: DataFrame, n: int = C.CARD_REFERRERS, aliases: DataFrame | None = None
) -> DataFrame:
    ranked = top_n(referrers, DAY, [F.desc("visits"), F.asc("referrer")], n)
    return with_kind(ranked, aliases)


def top_pages(landing: DataFrame, n: int = C.CARD_LANDING_PAGES) -> DataFrame:
    return top_n(landing, DAY, [F.desc("visits"), F.asc("page")], n)


def fill_sites(daily: DataFrame, sites: DataFrame, start: str, end: str) -> DataFrame:
    """A traffic row for every configured site and date; zeros where nothing was seen."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    measures = [c for c in ("visits", "views", "bytes") if c in daily.columns]
    return (
        sites.select("host", F.explode(days).alias("date"))
        .join(daily, DAY, "left")
        .select(*DAY, *[zero(F.col(c)).alias(c) for c in measures])
    )
