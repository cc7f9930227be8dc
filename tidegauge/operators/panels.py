"""Shares and notes behind the report panels. Inputs are card rows, a few per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.functions.ranking import site_keys, top_n
from tidegauge.functions.scalars import (
    kind_label,
    ratio,
    referrer_label,
    round_half_up,
)
from tidegauge.functions.text import byte_size, literal, number, plural, sentence

MIN_BAR = 7


def _of_listed(df: DataFrame, column: str) -> Column:
    return ratio(F.col(column), F.sum(column).over(W.partitionBy(*site_keys(df))))


def _bar(value: Column, largest: Column) -> Column:
    return F.greatest(F.lit(MIN_BAR), round_half_up(value / F.greatest(F.lit(1), largest) * 100))


def referrer_share(card: DataFrame) -> DataFrame:
    """Share of the listed referrers; external bars use their own scale."""
    site = W.partitionBy(*site_keys(card))
    external = F.col("kind") != "direct"
    largest = F.max(F.when(external, F.col("visits"))).over(site)
    return (
        card.withColumn("share", _of_listed(card, "visits"))
        .withColumn("bar", F.when(external, _bar(F.col("visits"), largest)).otherwise(100))
        .withColumn("label", referrer_label(F.col("referrer")))
        .withColumn("tag", kind_label(F.col("kind")))
    )


def country_share(card: DataFrame) -> DataFrame:
    largest = F.max("visits").over(W.partitionBy(*site_keys(card)))
    return card.withColumn("share", _of_listed(card, "visits")).withColumn(
        "bar", _bar(F.col("visits"), largest)
    )


def status_share(card: DataFrame) -> DataFrame:
    return card.withColumn("share", _of_listed(card, "requests")).withColumn(
        "is_error", F.col("status") >= 400
    )


def channel_share(mix: DataFrame, measured: DataFrame, visits: DataFrame) -> DataFrame:
    """One row per channel of the source mix with its share of all sessions.

    The internal channel is left out when it was never measured; the residual is
    marked as not being a channel. All inputs are one-row totals.
    """
    one = F.lit(1).alias("one")
    row = (
        mix.select("*", one)
        .join(measured.select("internal_measured", one), "one")
        .join(visits.select("visits", one), "one")
    )
    names = ("direct", "search", "social", "referral", "internal", "unattributed")
    long = row.unpivot(["internal_measured", "visits"], list(names), "channel", "sessions")
    return (
        long.where((F.col("channel") != "internal") | F.col("internal_measured"))
        .withColumn("share", ratio(F.col("sessions"), F.col("visits")))
        .withColumn("is_channel", F.col("channel") != "unattributed")
        .select("channel", "sessions", "share", "is_channel")
    )


def crawler_hosts(sites: DataFrame) -> DataFrame:
    """Flooded hosts by excluded sessions, with their share of everything measured."""
    rum = sites.where(F.col("measurement") == "rum")
    measured = F.sum(F.col("visits") + F.col("bot_visits"))
    everything = rum.agg(measured.alias("everything"), F.lit(1).alias("one"))
    return (
        rum.where(F.col("bot_visits") > 0)
        .select("host", "bot_visits", "bot_days", "partial_visits", F.lit(1).alias("one"))
        .join(everything, "one")
        .withColumn("share", ratio(F.col("bot_visits"), F.col("everything")))
        .drop("one", "everything")
        .orderBy(F.desc("bot_visits"), "host")
    )


def recovered_note() -> str:
    """What a site's figure covers once flooded days are in the period, as SQL text."""
    flooded = plural("bot_days", "day", "days")
    clean = sentence(
        C.CLEAN_DAYS_NOTE, days="string(clean_days)", day_word=plural("clean_days", "day", "days")
    )
    recovered = sentence(
        C.RECOVERED_NOTE,
        sessions=number("partial_visits"),
        session_word=plural("partial_visits", "session", "sessions"),
        day_word=flooded,
    )
    nothing = sentence(C.NOTHING_RECOVERED, day_word=flooded)
    why = literal(C.RECOVERED_WHY)
    return (
        f"CASE WHEN partial_days = 0 THEN IF(clean_days > 0, concat({clean}, '.'), '')"
        f" WHEN partial_visits = 0 AND clean_days > 0 THEN concat({clean}, {nothing})"
        f" WHEN partial_visits = 0 THEN {literal(C.NOTHING_MEASURED)}"
        f" WHEN clean_days > 0 THEN concat({clean}, ', plus ', {recovered}, {why})"
        f" ELSE concat({literal(C.RECOVERED_ONLY)}, {recovered}, {why}) END"
    )


def zone_note() -> str:
    return sentence(
        C.ZONE_NOTE, requests=number("views"), visits=number("visits"), bytes=byte_size("bytes")
    )


def panel_notes(sites: DataFrame) -> DataFrame:
    """The note of each site: request volume for zone hosts, flood cover for the rest."""
    note = F.expr(f"IF(measurement = 'zone', {zone_note()}, {recovered_note()})")
    return sites.select("host", "measurement", note.alias("note"))


def first_of_lens(rows: DataFrame, column: str, n: int = C.PANEL_NOTE_ROWS) -> DataFrame:
    """First few non-content paths or error statuses of a zone host."""
    return top_n(rows, site_keys(rows), [F.desc("requests"), F.asc(column)], n)
