"""Crawler floods: telling them from people by the shape of a day's traffic."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.config import FloodRules
from tidegauge.functions.ranking import site_keys
from tidegauge.functions.scalars import ratio, zero
from tidegauge.functions.text import fixed, percent, sentence


def _stacked(traffic: DataFrame, kinds: DataFrame) -> DataFrame:
    """Traffic rows and direct-referrer rows in the same columns."""
    keys = site_keys(traffic)
    no = F.lit(0).cast("long")
    size = F.col("bytes") if "bytes" in traffic.columns else no
    measured = traffic.select(
        *keys,
        "date",
        zero(F.col("visits")).alias("visits"),
        zero(F.col("views")).alias("views"),
        zero(size).alias("bytes"),
        no.alias("direct"),
        F.lit(True).alias("measured"),
    )
    direct = kinds.where(F.col("kind") == "direct").select(
        *keys,
        "date",
        no.alias("visits"),
        no.alias("views"),
        no.alias("bytes"),
        zero(F.col("visits")).alias("direct"),
        F.lit(False).alias("measured"),
    )
    return measured.unionByName(direct)


def _with_signature(days: DataFrame, rules: FloodRules) -> DataFrame:
    visits, rate = F.col("visits"), F.col("pages_per_session")
    return (
        days.withColumn("non_direct", F.greatest(F.lit(0), visits - F.col("direct")))
        .withColumn("pages_per_session", ratio(F.col("views"), visits))
        .withColumn("direct_share", ratio(F.col("direct"), visits))
        .withColumn(
            "signature",
            (visits > 0)
            & (rate > 0)
            & (rate <= rules.flat_pages)
            & (F.col("direct_share") >= rules.direct_share),
        )
    )


SUMMED = ("visits", "views", "bytes", "direct")


def day_shape(traffic: DataFrame, kinds: DataFrame, rules: FloodRules = FloodRules()) -> DataFrame:
    """Direct and referred sessions, pages per session and the crawler signature.

    Traffic rows and direct-referrer rows are stacked and summed instead of
    joined. Both go through one shuffle on the site, which the baseline window
    and every per-site aggregate after it use again. A site has one row per day
    of history here, however busy it is.
    """
    keys = site_keys(traffic)
    days = (
        _stacked(traffic, kinds)
        .repartition(*keys)
        .groupBy(*keys, "date")
        .agg(*[F.sum(c).alias(c) for c in SUMMED], F.max("measured").alias("measured"))
        .where("measured")
        .drop("measured")
    )
    return _with_signature(days, rules)


def flood_baseline(days: DataFrame) -> DataFrame:
    """Add what a normal day of the site is.

    The lower median of the days without the signature, or the 25th percentile of
    all days when fewer than three such days are left.
    """
    over = f"OVER (PARTITION BY {', '.join(site_keys(days))})"
    clean = "CASE WHEN NOT signature THEN visits END"
    return days.withColumn(
        "baseline",
        F.expr(
            f"CASE WHEN count({clean}) {over} >= 3"
            f" THEN percentile_disc(0.5) WITHIN GROUP (ORDER BY {clean}) {over}"
            f" ELSE percentile_disc(0.25) WITHIN GROUP (ORDER BY visits) {over} END"
        ).cast("long"),
    )


def _with_verdict(days: DataFrame, rules: FloodRules) -> DataFrame:
    bar = F.greatest(F.col("baseline"), F.lit(1)) * F.lit(float(rules.multiple))
    return days.withColumn(
        "flood",
        F.col("signature")
        & (F.col("visits") >= rules.min_visits)
        & (F.col("visits") >= bar),
    )


def classify_floods(
    traffic: DataFrame, kinds: DataFrame, rules: FloodRules = FloodRules()
) -> DataFrame:
    """Every stored day with its shape, its site's baseline and the verdict."""
    return _with_verdict(flood_baseline(day_shape(traffic, kinds, rules)), rules)


def classify_many(
    traffic: DataFrame,
    kinds: DataFrame,
    hosts: DataFrame,
    dates: Sequence[dt.date],
    history_days: int,
    rules: FloodRules = FloodRules(),
) -> DataFrame:
    """``classify_floods`` for many report dates: the same rows, tagged ``as_of``.

    Each report date has a history of its own, of ``history_days`` up to itself, and so its
    own baseline. The stored days go to their site once; there a window slides over them,
    and each report date of ``hosts`` takes the days and the order statistic of its window.
    Days are not copied to their report dates before the shuffle, nor sorted once for each.
    """
    no = F.lit(0).cast("long")
    ends = F.explode(F.array(*[F.lit(d) for d in dates]))
    wanted = hosts.select("host", ends.alias("date"), *[no.alias(c) for c in SUMMED], F.lit(False).alias("measured"), F.lit(True).alias("wanted"))
    low, high = min(dates) - dt.timedelta(history_days - 1), max(dates)
    stacked = _stacked(traffic, kinds).where(F.col("date").between(F.lit(low), F.lit(high)))
    days = (
        stacked.withColumn("wanted", F.lit(False))
        .unionByName(wanted)
        .repartition("host")
        .groupBy("host", "date")
        .agg(*[F.sum(c).alias(c) for c in SUMMED], F.max("measured").alias("measured"), F.max("wanted").alias("wanted"))
    )
    shaped = _with_signature(days, rules)
    shape = ["date", *SUMMED, "non_direct", "pages_per_session", "direct_share", "signature"]
    window = W.partitionBy("host").orderBy(F.unix_date("date")).rangeBetween(1 - history_days, 0)
    history = F.collect_list(F.when(F.col("measured"), F.struct(*shape))).over(window)
    found = shaped.withColumn("history", history).where("wanted").select("host", F.col("date").alias("as_of"), "history")

    def quantile(values: Column, share: float) -> Column:
        """The smallest value that at least this share of the values do not exceed."""
        return F.get(F.sort_array(values), F.ceil(F.size(values) * share).cast("int") - 1)

    clean = F.transform(F.filter("history", lambda d: ~d["signature"]), lambda d: d["visits"])
    every = F.transform("history", lambda d: d["visits"])
    baseline = F.when(F.size(clean) >= 3, quantile(clean, 0.5)).otherwise(quantile(every, 0.25))
    rows = found.withColumn("baseline", baseline).withColumn("day", F.explode("history"))
    return _with_verdict(rows.select("as_of", "host", "day.*", "baseline"), rules)


def split_days(classified: DataFrame) -> DataFrame:
    """The part of each day that is people and the part that is crawlers.

    On a flooded day the referred sessions still count, as a floor; the direct
    sessions and all page views go to the crawler.
    """
    flood = F.col("flood")
    return classified.withColumns(
        {
            "human": F.when(flood, F.col("non_direct")).otherwise(F.col("visits")),
            "crawler": F.when(flood, F.col("visits") - F.col("non_direct")).otherwise(0),
            "human_views": F.when(flood, 0).otherwise(F.col("views")),
            "crawler_views": F.when(flood, F.col("views")).otherwise(0),
            "partial": flood,
        }
    )


def split_stored_days(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Stored rows with their split; a day that was not classified counts as zeros."""
    keys = [*site_keys(rows), "date"]
    parts = ["human", "crawler", "human_views", "crawler_views"]
    return rows.join(split.select(*keys, *parts, "partial"), keys, "left").select(
        *keys,
        *[zero(F.col(c)).alias(c) for c in parts],
        F.coalesce("partial", F.lit(False)).alias("partial"),
    )


def flood_dates(classified: DataFrame) -> DataFrame:
    return classified.where("flood").select(*site_keys(classified), "date")


def flood_reason() -> Column:
    """Why a day counts as flooded, as text."""
    reason = sentence(
        C.FLOOD_REASON,
        direct=percent("direct_share"),
        rate=fixed("pages_per_session", 1),
        multiple="string(floor(visits / greatest(baseline, 1) + 0.5D))",
    )
    return F.expr(f"CASE WHEN flood THEN {reason} END")


def flood_run(floods: DataFrame) -> DataFrame:
    """Consecutive flooded days ending at the report date; no row when it is clean.

    Counting back from ``as_of``, the n-th latest flooded day belongs to the run
    as long as it lies exactly n-1 days back.
    """
    keys = site_keys(floods)
    back = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("date")))
    return (
        floods.where(F.col("date") <= F.col("as_of"))
        .withColumn("back", back)
        .where(F.date_diff("as_of", "date") == F.col("back") - 1)
        .groupBy(*keys)
        .agg(F.count("*").alias("flood_run"))
    )
