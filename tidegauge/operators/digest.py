"""The daily digest and the run result, each as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.functions.ranking import top_n
from tidegauge.functions.scalars import strip_www, zero


def _today(split: DataFrame, sites: DataFrame) -> DataFrame:
    today = split.where(F.col("date") == F.col("as_of"))
    return today.join(sites.select("host"), "host", "left_semi")


def daily_digest(split: DataFrame, sites: DataFrame) -> DataFrame:
    """Human and crawler sessions of the day over all sites, and the flooded hosts."""
    return _today(split, sites).agg(
        F.coalesce(F.sum("human"), F.lit(0)).alias("human_visits"),
        F.coalesce(F.sum("crawler"), F.lit(0)).alias("bot_visits"),
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.col("flood"), F.col("host")))), ", "
        ).alias("flooded"),
    )


def digest_ranked(split: DataFrame, sites: DataFrame, n: int = C.DIGEST_HOSTS) -> DataFrame:
    """The busiest hosts of the day by human sessions."""
    people = _today(split, sites).where(F.col("human") > 0)
    ranked = top_n(people.select("as_of", "host", "human"), ["as_of"],
                   [F.desc("human"), F.asc("host")], n)
    return ranked.select("rank", strip_www(F.col("host")).alias("host"), "human")


def digest_body(
    digest: DataFrame,
    ranked: DataFrame,
    alert: DataFrame,
    search_ok: bool = True,
    failed_hosts: tuple[str, ...] = (),
    notes: tuple[str, ...] = (),
) -> DataFrame:
    """Text of the digest, one row. ``ranked`` and ``alert`` are a few rows at most."""
    lines = ranked.agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "host", "human"))),
                lambda r: F.concat(r["host"], F.lit(": "), r["human"].cast("string")),
            ),
            "\n",
        ).alias("lines"),
        F.lit(1).alias("one"),
    )
    finding = alert.agg(
        F.max(F.concat(F.lit("\n\n❗ "), "headline", F.lit("\n→ "), "action")).alias("finding"),
        F.lit(1).alias("one"),
    )
    crawlers = F.when(
        F.col("bot_visits") > 0,
        F.concat(
            F.lit("\n🤖 "), F.col("bot_visits").cast("string"),
            F.lit(" crawler sessions excluded ("), "flooded", F.lit(")"),
        ),
    )
    if search_ok:
        warning = ""
    elif failed_hosts:
        warning = f"\n⚠ no search data: {', '.join(failed_hosts)}"[:300]
    else:
        warning = f"\n⚠ keywords: {notes[0] if notes else 'skipped'}"
    joined = digest.withColumn("one", F.lit(1)).join(lines, "one").join(finding, "one")
    body = F.concat(
        F.col("human_visits").cast("string"), F.lit(" visitors (24h)\n"), "lines",
        F.coalesce(crawlers, F.lit("")), F.lit(warning), F.coalesce("finding", F.lit("")),
    )
    return joined.select("human_visits", "bot_visits", "flooded", body.alias("body"))


def search_ok(notes: list[str] | tuple[str, ...]) -> bool:
    """Search data is complete when no note is about a failed search pull."""
    return not any(note.startswith(C.SEARCH_NOTE_PREFIX) for note in notes)


def clip_note(note: str) -> str:
    limit = C.AUTH_NOTE_LENGTH if note.startswith(C.SEARCH_AUTH_PREFIX) else C.NOTE_LENGTH
    return note[:limit]


def run_result(
    traffic: DataFrame,
    digest: DataFrame,
    alert: DataFrame,
    date: Column,
    notes: tuple[str, ...] = (),
    failed_hosts: tuple[str, ...] = (),
) -> DataFrame:
    """Outcome of a nightly run, one row. ``traffic`` is the day's stored traffic."""
    total = traffic.agg(
        F.coalesce(F.sum("visits"), F.lit(0)).alias("total_visits"), F.lit(1).alias("one")
    )
    top = alert.agg(
        *[F.max(c).alias(f"top_{c}") for c in ("kind", "host", "headline")], F.lit(1).alias("one")
    )
    return (
        total.join(digest.withColumn("one", F.lit(1)), "one")
        .join(top, "one")
        .select(
            date.alias("date"),
            "total_visits",
            "human_visits",
            "bot_visits",
            F.lit(search_ok(notes)).alias("search_ok"),
            F.lit(", ".join(failed_hosts)).alias("failed_hosts"),
            "top_kind",
            "top_host",
            "top_headline",
            F.lit(C.NOTE_SEPARATOR.join(clip_note(n) for n in notes)).alias("notes"),
        )
    )


def headline_from_traffic(traffic: DataFrame, n: int = C.DIGEST_HOSTS) -> DataFrame:
    """Fallback ranking by raw sessions, for when no digest could be made."""
    ranked = top_n(traffic.select("date", "host", "visits"), ["date"],
                   [F.desc("visits"), F.asc("host")], n)
    return ranked.select("rank", strip_www(F.col("host")).alias("host"), zero(F.col("visits")).alias("human"))
