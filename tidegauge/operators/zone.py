"""Request-measured hosts: what crawlers are known to have done, and no more.

Neither lens yields a human figure, and the two overlap, so they are never added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.functions.ranking import site_keys
from tidegauge.functions.scalars import is_non_content, ratio, zero


def crawler_route(measurement: Column) -> Column:
    return F.when(measurement == "zone", "zone").otherwise("flood")


def _is_verified() -> Column:
    category = F.col("category")
    return category.isNotNull() & ~category.isin("", C.UNVERIFIED_CATEGORY)


def verified_bots(bots: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Verified crawler volume per site: a floor. ``sites`` adds unmeasured sites."""
    keys = site_keys(bots)
    verified = _is_verified()

    def total(column: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, zero(F.col(column)))), F.lit(0))

    summed = bots.groupBy(*keys).agg(
        total("requests", verified).alias("verified_requests"),
        total("visits", verified).alias("verified_visits"),
        total("requests", ~verified).alias("unverified_requests"),
        total("visits", ~verified).alias("unverified_visits"),
        F.lit(True).alias("measured"),
    )
    if sites is not None:
        counts = [c for c in summed.columns if c not in (*keys, "measured")]
        summed = sites.join(summed, keys, "left").select(
            *keys,
            *[zero(F.col(c)).alias(c) for c in counts],
            F.coalesce("measured", F.lit(False)).alias("measured"),
        )
    requests = F.col("verified_requests") + F.col("unverified_requests")
    return (
        summed.withColumn("total_requests", requests)
        .withColumn("total_visits", F.col("verified_visits") + F.col("unverified_visits"))
        .withColumn("verified_share", ratio(F.col("verified_requests"), F.col("total_requests")))
    )


def verified_categories(bots: DataFrame) -> DataFrame:
    return (
        bots.where(_is_verified())
        .select(*site_keys(bots), "category", "requests", "visits")
        .orderBy("host", F.desc("requests"), "category")
    )


def non_content_paths(pages: DataFrame) -> DataFrame:
    """Requests for paths that nobody reads."""
    return (
        pages.where(is_non_content(F.col("page")))
        .groupBy(*site_keys(pages), "page")
        .agg(F.sum(zero(F.col("requests"))).alias("requests"))
    )


def error_statuses(statuses: DataFrame) -> DataFrame:
    """Requests answered with status 400 or above."""
    return (
        statuses.where(F.col("status") >= 400)
        .groupBy(*site_keys(statuses), "status")
        .agg(F.sum(zero(F.col("requests"))).alias("requests"))
    )


def non_content_totals(pages: DataFrame, statuses: DataFrame) -> DataFrame:
    """Both components per site, side by side and never summed."""
    keys = site_keys(pages)
    no = F.lit(0).cast("long")
    paths = non_content_paths(pages).select(
        *keys, F.col("requests").alias("path_requests"), no.alias("error_requests")
    )
    errors = error_statuses(statuses).select(
        *keys, no.alias("path_requests"), F.col("requests").alias("error_requests")
    )
    return (
        paths.unionByName(errors)
        .groupBy(*keys)
        .agg(
            F.sum("path_requests").alias("path_requests"),
            F.sum("error_requests").alias("error_requests"),
        )
    )


def failing_paths(log: DataFrame) -> DataFrame:
    """Requests by failing path and status, which the raw log still holds together."""
    return (
        log.where(F.col("status") >= 400)
        .groupBy("date", "host", "path", "status")
        .agg(F.sum("requests").alias("requests"))
    )


def content_and_noise(pages: DataFrame) -> DataFrame:
    """Top files marked as content or as asset and crawler noise."""
    return pages.withColumn(
        "lens", F.when(is_non_content(F.col("page")), "noise").otherwise("content")
    )
