"""Totals over all sites and 14-row comparators.

Session-measured and request-measured sites are never summed together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.functions.ranking import exact_median, last_rows
from tidegauge.functions.scalars import expected_ctr, ratio, round_half_up, zero
from tidegauge.functions.text import sentence
from tidegauge.operators.sites import CHANNELS


#: How a total gets a column of its rows: of a table of its own, or of one kind of stacked rows.
Get = Callable[[str], Column]


def _sum(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def _rum(sites: DataFrame) -> DataFrame:
    return sites.where(F.col("measurement") == "rum")


def rum_columns(c: Get = F.col) -> list[Column]:
    """Aggregates over site rows; sites of the other measurement do not count."""
    rum = c("measurement") == "rum"
    summed = ("visits", "views", "previous_visits", "bot_visits", "bot_views",
              "previous_bot_visits", "partial_visits")
    return [
        *[_sum(F.when(rum, c(name))).alias(name) for name in summed],
        F.count_if(rum & (c("partial_days") > 0)).alias("partial_sites"),
        _sum(F.when(rum, c("bot_days"))).alias("flooded_site_days"),
        F.count_if(rum & (c("bot_days") > 0)).alias("flooded_sites"),
    ]


def rum_totals(sites: DataFrame) -> DataFrame:
    return sites.agg(*rum_columns())


def zone_columns(c: Get = F.col) -> list[Column]:
    zone = c("measurement") == "zone"
    hosts = F.sort_array(F.collect_list(F.when(zone, c("host"))))
    return [
        _sum(F.when(zone, c("visits"))).alias("visits"),
        _sum(F.when(zone, c("views"))).alias("requests"),
        _sum(F.when(zone, c("bytes"))).alias("bytes"),
        F.count_if(zone).alias("sites"),
        F.array_join(hosts, ",").alias("hosts"),
    ]


def zone_totals(sites: DataFrame) -> DataFrame:
    """Volume of request-measured sites in its own units; hosts are config-bounded."""
    return sites.agg(*zone_columns())


def mix_columns(c: Get = F.col) -> list[Column]:
    rum = c("measurement") == "rum"
    return [_sum(F.when(rum, c(name))).alias(name) for name in (*CHANNELS, "unattributed")]


def source_mix(sources: DataFrame) -> DataFrame:
    return sources.agg(*mix_columns())


def internal_rows(referrers: DataFrame, sites: DataFrame) -> DataFrame:
    hosts = _rum(sites).select("host")
    return referrers.where(F.col("kind") == "internal").join(hosts, "host", "left_semi")


def internal_measured(referrers: DataFrame, sites: DataFrame) -> DataFrame:
    """Whether any stored row of the period shows the internal channel at all."""
    return internal_rows(referrers, sites).agg((F.count("*") > 0).alias("internal_measured"))


def count_columns(c: Get = F.col) -> list[Column]:
    return [
        F.count(c("host")).alias("domains"),
        F.count_if(c("measurement") == "rum").alias("rum_domains"),
        F.count_if(c("measurement") == "zone").alias("zone_domains"),
        F.count_if(c("visits") > 0).alias("active"),
    ]


def site_counts(sites: DataFrame) -> DataFrame:
    return sites.agg(*count_columns())


def folded(rows: Mapping[str, DataFrame], totals: Mapping[str, Sequence[Column]], keys: Sequence[str] = ()) -> DataFrame:
    """Totals over several kinds of rows in one grouping, by ``keys``.

    Rows of all kinds are stacked, each kind as one struct column of its name that is null in
    the others; aggregates name the kind whose rows they see (``of``). So no total is
    joined to another, and each kind of rows is read once for all totals over it.
    """
    stacked = [df.select(*keys, F.struct(*[x for x in df.columns if x not in keys]).alias(name)) for name, df in rows.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    return whole.groupBy(*keys).agg(*[t for own in totals.values() for t in own])


def of(name: str) -> Get:
    """Columns of one kind of stacked rows."""
    return lambda column: F.col(f"{name}.{column}")


def with_ratios(totals: DataFrame) -> DataFrame:
    """Ratios over one row that holds the session, source and search totals."""
    visits, bots = F.col("visits"), F.col("bot_visits")
    previous = F.col("previous_visits")
    return (
        totals.withColumn("delta", F.when(previous != 0, (visits - previous) / previous))
        .withColumn("pages_per_session", ratio(F.col("views"), visits))
        .withColumn("search_share", ratio(F.col("search"), visits))
        .withColumn("bot_share", ratio(bots, visits + bots))
        .withColumn("search_ctr", ratio(F.col("clicks"), F.col("impressions")))
    )


def search_columns(c: Get = F.col) -> list[Column]:
    weighted = F.sum(c("position") * c("impressions"))
    return [
        _sum(c("clicks")).alias("clicks"),
        _sum(c("impressions")).alias("impressions"),
        F.count(c("host")).alias("search_domains"),
        ratio(weighted, F.sum(c("impressions"))).alias("weighted_position"),
    ]


def search_totals(summary: DataFrame) -> DataFrame:
    """Whole-corpus clicks and impressions, sites with data, weighted position."""
    return summary.agg(*search_columns())


def seen_often(c: Get = F.col, min_impressions: int = C.POSITION_MIN_IMPRESSIONS) -> Column:
    return (c("position") > 0) & (c("impressions") >= min_impressions)


def position_columns(c: Get = F.col, min_impressions: int = C.POSITION_MIN_IMPRESSIONS) -> list[Column]:
    often = seen_often(c, min_impressions)
    return [
        F.count_if(often).alias("position_queries"),
        F.count_if(often & (c("position") <= C.TOP_TEN)).alias("top10_queries"),
    ]


def median_position(
    keywords: DataFrame, min_impressions: int = C.POSITION_MIN_IMPRESSIONS
) -> DataFrame:
    """Median position of the queries seen often enough, and how many are in the top ten."""
    counts = keywords.agg(*position_columns(F.col, min_impressions))
    median = exact_median(keywords.where(seen_often(F.col, min_impressions)), "position").agg(
        F.coalesce(F.max("median"), F.lit(0.0)).alias("median_position")
    )
    # Two one-row aggregates side by side.
    return counts.withColumn("one", F.lit(1)).join(median.withColumn("one", F.lit(1)), "one").drop(
        "one"
    )


def sample_columns(c: Get = F.col) -> list[Column]:
    """What the stored queries would earn at their own positions, and what they earn."""
    placed = c("position") > 0
    impressions, clicks = F.when(placed, c("impressions")), F.when(placed, c("clicks"))
    return [
        ratio(F.sum(impressions * expected_ctr(c("position"))), F.sum(impressions)).alias("expected_ctr"),
        ratio(F.sum(clicks), F.sum(impressions)).alias("sample_ctr"),
        _sum(clicks).alias("sample_clicks"),
        _sum(impressions).alias("sample_impressions"),
        F.count_if(placed).alias("sample_queries"),
    ]


def with_sample_share(totals: DataFrame, corpus: str) -> DataFrame:
    """The sample's share of all impressions (column ``corpus``), and whether it is thin."""
    share = ratio(F.col("sample_impressions"), F.col(corpus))
    return totals.withColumn("sample_share", share).withColumn("thin_sample", thin_sample(F.col("sample_share")))


def expected_ctr_mix(keywords: DataFrame, summary: DataFrame) -> DataFrame:
    """What the stored queries would earn at their own positions, and their share.

    Both sides of the comparison come from the same keyword rows.
    """
    sample = keywords.agg(*sample_columns(), F.lit(1).alias("one"))
    corpus = summary.agg(_sum("impressions").alias("corpus"), F.lit(1).alias("one"))
    return with_sample_share(sample.join(corpus, "one"), "corpus").drop("one", "corpus")


def thin_sample(share: Column) -> Column:
    return (share > 0) & (share < C.THIN_SAMPLE_SHARE)


def traffic_trend(split: DataFrame, kinds: DataFrame, sites: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Human sessions, clean views and search sessions by date over session sites.

    Search sessions of a date without traffic are ignored. Both kinds of rows are stacked
    and grouped once.
    """
    hosts = _rum(sites).select("host").distinct()
    none = F.lit(None).cast("long")
    days = split.select(*keys, "date", "host", F.col("human").alias("visits"), F.col("human_views").alias("views"), none.alias("search"))
    search = kinds.where(F.col("kind") == "search").select(*keys, "date", "host", none.alias("visits"), none.alias("views"), F.col("visits").alias("search"))
    measured = F.col("visits").isNotNull()
    return (
        days.unionByName(search)
        .join(hosts, "host", "left_semi")
        .groupBy(*keys, "date")
        .agg(F.sum("visits").alias("visits"), F.sum("views").alias("views"), zero(F.sum("search")).alias("search"))
        .where(measured)
    )


def last_dates(trend: DataFrame, n: int = C.COMPARATOR_ROWS, keys: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` dates that are present; the input has one row per date."""
    return last_rows(trend, keys, n) if keys else trend.orderBy(F.desc("date")).limit(n)


def trend_columns(c: Get = F.col) -> list[Column]:
    return [
        F.count(c("date")).alias("trend_days"),
        *[
            F.coalesce(F.avg(c(name)), F.lit(0.0)).alias(f"{name}_per_day")
            for name in ("visits", "views", "search")
        ],
    ]


def traffic_comparator(trend: DataFrame) -> DataFrame:
    """Daily means over the last 14 dates present."""
    return last_dates(trend).agg(*trend_columns())


def search_trend(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Clicks and impressions by snapshot; snapshots overlap, so only means are legal."""
    label = F.nullif(F.col("search_window"), F.lit(""))
    return summary.groupBy(*keys, "date").agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.max(label).alias("search_window"),
    )


def snapshot_columns(c: Get = F.col) -> list[Column]:
    return [
        F.count(c("date")).alias("snapshots"),
        F.coalesce(F.avg(c("clicks")), F.lit(0.0)).alias("clicks_per_snapshot"),
        F.coalesce(F.avg(c("impressions")), F.lit(0.0)).alias("impressions_per_snapshot"),
        ratio(F.sum(c("clicks")), F.sum(c("impressions"))).alias("trend_ctr"),
        F.min_by(c("search_window"), c("date")).alias("window_first"),
        F.max_by(c("search_window"), c("date")).alias("window_last"),
    ]


def search_comparator(trend: DataFrame) -> DataFrame:
    return last_dates(trend).agg(*snapshot_columns())


def per_day_rate(value: Column, days_available: Column, period_days: int) -> Column:
    """Rounded value per stored day, for periods longer than a day."""
    if period_days <= 1:
        return F.lit(None).cast("long")
    return F.when(days_available > 0, round_half_up(value / days_available))


def is_stale(updated_at: Column, now: Column) -> Column:
    age = F.unix_timestamp(now) - F.unix_timestamp(updated_at)
    return updated_at.isNull() | (age > C.STALE_HOURS * 3600)


def coverage_note(days_available: str, period_days: int) -> Column:
    """Text when fewer days are stored than the period asks for."""
    note = sentence(C.COVERAGE_NOTE, days=f"string({days_available})", period=f"'{period_days}'")
    short = f"{period_days} > 1 AND {days_available} < {period_days}"
    return F.expr(f"CASE WHEN {short} THEN {note} END")
