"""Per-site report aggregates. Inputs are tagged with ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.functions.ranking import last_rows, site_keys, top_n
from tidegauge.functions.scalars import ratio, zero
from tidegauge.operators.floods import flood_reason

CHANNELS = ("direct", "search", "social", "referral", "internal")


def _in_current(days: int) -> Column:
    age = F.date_diff("as_of", "date")
    return (age >= 0) & (age < days)


def _in_previous(days: int) -> Column:
    age = F.date_diff("as_of", "date")
    return (age >= days) & (age < 2 * days)


def site_traffic(split: DataFrame, days: int) -> DataFrame:
    """Both periods of every site in one pass over its split days."""
    keys = site_keys(split)
    partial = F.col("partial")

    def total(column: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).cast("long")

    def measures(prefix: str, rows: Column) -> list[Column]:
        return [
            total("human", rows).alias(f"{prefix}visits"),
            total("human_views", rows).alias(f"{prefix}views"),
            total("human", rows & partial).alias(f"{prefix}partial_visits"),
            F.count_if(rows & partial).alias(f"{prefix}partial_days"),
            total("crawler", rows & partial).alias(f"{prefix}bot_visits"),
            total("crawler_views", rows & partial).alias(f"{prefix}bot_views"),
            F.count_if(rows & partial).alias(f"{prefix}bot_days"),
            F.count_if(rows & ~partial).alias(f"{prefix}clean_days"),
        ]

    current, previous = _in_current(days), _in_previous(days)
    extra = [total("bytes", current).alias("bytes")] if "bytes" in split.columns else []
    return split.groupBy(*keys).agg(
        *measures("", current), *measures("previous_", previous), *extra
    )


def site_delta() -> Column:
    """Relative change; NULL where a like-for-like comparison does not exist."""
    comparable = (
        (F.col("previous_visits") != 0)
        & (F.col("partial_days") == 0)
        & (F.col("previous_partial_days") == 0)
    )
    change = F.col("visits") - F.col("previous_visits")
    return F.when(comparable, change / F.col("previous_visits"))


def with_rates(traffic: DataFrame) -> DataFrame:
    """Delta, and pages per session over the sessions of clean days."""
    clean = F.col("visits") - F.col("partial_visits")
    previous_clean = F.col("previous_visits") - F.col("previous_partial_visits")
    change = F.col("pages_per_session") - F.col("previous_pages_per_session")
    return (
        traffic.withColumn("delta", site_delta())
        .withColumn("pages_per_session", ratio(F.col("views"), clean))
        .withColumn("previous_pages_per_session", ratio(F.col("previous_views"), previous_clean))
        .withColumn("pages_per_session_delta", F.when(F.col("previous_visits") != 0, change))
    )


def merge_landing(landing: DataFrame, floods: DataFrame) -> DataFrame:
    """Landing pages over the period without flooded days, which carry no referrer."""
    keys = site_keys(landing)
    return (
        landing.join(floods, [*keys, "date"], "left_anti")
        .groupBy(*keys, "page")
        .agg(F.sum("visits").alias("visits"), F.sum("views").alias("views"))
    )


def merge_referrers(referrers: DataFrame, floods: DataFrame) -> DataFrame:
    """Referrers over the period; a flooded day loses only its direct sessions."""
    keys = site_keys(referrers)
    flagged = floods.withColumn("flooded", F.lit(True))
    return (
        referrers.join(flagged, [*keys, "date"], "left")
        .where(F.col("flooded").isNull() | (F.col("kind") != "direct"))
        .groupBy(*keys, "referrer", "kind")
        .agg(F.sum("visits").alias("visits"))
    )


def channel(kind: Column) -> Column:
    """Channel of the source mix: other sites and AI engines are both referrals."""
    return F.when(kind.isin("ref", "ai"), "referral").when(kind.isin(*CHANNELS), kind)


def site_sources(referrers: DataFrame, traffic: DataFrame) -> DataFrame:
    """Sessions by channel, and the residual that no stored referrer accounts for."""
    keys = site_keys(traffic)
    sums = (
        referrers.withColumn("channel", channel(F.col("kind")))
        .groupBy(*keys)
        .agg(*[F.sum(F.when(F.col("channel") == c, F.col("visits"))).alias(c) for c in CHANNELS])
    )
    attributed = sum((F.col(c) for c in CHANNELS[1:]), F.col(CHANNELS[0]))
    return (
        traffic.select(*keys, "visits")
        .join(sums, keys, "left")
        .select(*keys, "visits", *[zero(F.col(c)).alias(c) for c in CHANNELS])
        .withColumn("unattributed", F.greatest(F.lit(0), F.col("visits") - attributed))
        .drop("visits")
    )


def latest_anomaly(classified: DataFrame) -> DataFrame:
    """Reason text of the most recent flooded day in the history."""
    return (
        classified.where("flood")
        .groupBy(*site_keys(classified))
        .agg(F.max_by(flood_reason(), "date").alias("anomaly"))
    )


def referrer_card(referrers: DataFrame, n: int = C.CARD_REFERRERS) -> DataFrame:
    order = [F.desc("visits"), F.asc("referrer"), F.asc("kind")]
    return top_n(referrers, site_keys(referrers), order, n)


def landing_card(landing: DataFrame, n: int = C.CARD_LANDING_PAGES) -> DataFrame:
    return top_n(landing, site_keys(landing), [F.desc("visits"), F.asc("page")], n)


def file_card(zone_pages: DataFrame, n: int = C.CARD_LANDING_PAGES) -> DataFrame:
    """Most requested files of a zone site over the period."""
    keys = site_keys(zone_pages)
    merged = zone_pages.groupBy(*keys, "page").agg(
        F.sum("requests").alias("requests"), F.sum("zone_visits").alias("zone_visits")
    )
    return top_n(merged, keys, [F.desc("requests"), F.asc("page")], n)


def _by_clicks(key: str) -> list[Column]:
    return [F.desc("clicks"), F.desc("impressions"), F.asc(key)]


def keyword_card(keywords: DataFrame, n: int = C.CARD_KEYWORDS) -> DataFrame:
    ranked = top_n(keywords, site_keys(keywords), _by_clicks("query"), n)
    return ranked.withColumn("ctr", ratio(F.col("clicks"), F.col("impressions")))


def search_page_card(pages: DataFrame, n: int = C.CARD_SEARCH_PAGES) -> DataFrame:
    ranked = top_n(pages, site_keys(pages), _by_clicks("page"), n)
    computed = ratio(F.col("clicks"), F.col("impressions"))
    return ranked.withColumn("ctr", F.coalesce(F.col("ctr"), computed))


def country_card(countries: DataFrame, n: int = C.CARD_COUNTRIES) -> DataFrame:
    return top_n(countries, site_keys(countries), [F.desc("visits"), F.asc("country")], n)


def status_card(statuses: DataFrame, n: int = C.CARD_STATUSES) -> DataFrame:
    return top_n(statuses, site_keys(statuses), [F.desc("requests"), F.asc("status")], n)


def site_search_summary(sites: DataFrame, summary: DataFrame) -> DataFrame:
    """The latest search row of every site; NULLs and ``has_search`` false without one."""
    keys = site_keys(sites)
    columns = ["clicks", "impressions", "ctr", "position"]
    rows = summary.select(*keys, *[zero(F.col(c)).alias(c) for c in columns])
    return sites.select(*keys).join(rows.withColumn("has_search", F.lit(True)), keys, "left").select(
        *keys, *columns, F.coalesce("has_search", F.lit(False)).alias("has_search")
    )


def window_label(
    summary: DataFrame, keywords: DataFrame, pages: DataFrame
) -> DataFrame:
    """Search window of a site: from its summary, else its keywords, else its pages."""
    keys = site_keys(summary)

    def labels(df: DataFrame, source: str) -> DataFrame:
        label = F.nullif(F.col("search_window"), F.lit(""))
        return df.select(*keys, F.lit(source).alias("source"), label.alias("label"))

    def of(source: str) -> Column:
        return F.max(F.when(F.col("source") == source, F.col("label")))

    stacked = labels(summary, "summary").unionByName(labels(keywords, "keywords"))
    return (
        stacked.unionByName(labels(pages, "pages"))
        .groupBy(*keys)
        .agg(F.coalesce(of("summary"), of("keywords"), of("pages")).alias("search_window"))
    )


def sparkline(classified: DataFrame, n: int = C.SPARK_ROWS) -> DataFrame:
    """The last ``n`` stored days of each site with their flood mark."""
    rows = classified.select(*site_keys(classified), "date", "visits", "flood")
    return last_rows(rows, site_keys(classified), n)


def site_order(sites: DataFrame, sort: str = "traffic") -> DataFrame:
    """Session-measured sites first, then request-measured ones, each by ``sort``."""
    block = F.when(F.col("measurement") == "rum", 0).otherwise(1)
    by = {
        "traffic": [F.desc("visits"), F.asc("host")],
        "change": [F.desc_nulls_last("delta"), F.asc("host")],
        "name": [F.asc("host")],
    }[sort]
    return sites.orderBy(block, *by)
