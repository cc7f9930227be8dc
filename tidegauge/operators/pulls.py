"""What the outcomes of pulls mean for a run: what it may replace, and what it has to note."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.config import SiteConfig

SEARCH = ("keywords", "search_pages", "search_summary")


def expected_pulls(
    spark: SparkSession, config: SiteConfig, sources: Sequence[str], days: Sequence[dt.date], accounts: Sequence[str] = ()
) -> DataFrame:
    """(date, source, key) of every pull that a run needs."""
    searched = [s.host for s in config.sites if s.search_property]
    keys = {
        "beacons": list(config.accounts or accounts), "zone": config.hosts("zone"),
        **dict.fromkeys(SEARCH, searched), "forums": [host for host, _ in config.forums],
    }
    rows = [(s, key) for s in sources for key in keys[s]]
    dates = F.array(*[F.lit(d) for d in days])
    return spark.createDataFrame(rows, "source string, key string").select(F.explode(dates).alias("date"), "source", "key")


def good_pairs(outcomes: DataFrame, source: str, sites: DataFrame) -> DataFrame:
    """(date, host) of the sites for which a source has been pulled whole.

    Beacons of a site may come from any account, so a date is good only if all accounts are.
    """
    own = outcomes.where(F.col("source") == source)
    if source != "beacons":
        return own.where(F.col("ok") == 1).select("date", F.col("key").alias("host"))
    whole = own.groupBy("date").agg(F.min("ok").alias("ok")).where(F.col("ok") == 1)
    return whole.select("date").crossJoin(sites.where(F.col("measurement") == "rum").select("host"))


def failed_notes(outcomes: DataFrame) -> DataFrame:
    """A numbered note per source and key that failed on any date."""
    order = F.array_position(F.array(*[F.lit(s) for s in C.PULL_NOTES]), F.col("source"))
    prefix = F.create_map(*[F.lit(x) for pair in C.PULL_NOTES.items() for x in pair])[F.col("source")]
    failed = outcomes.where(F.col("ok") == 0).groupBy("source", "key").agg(F.min("message").alias("message"))
    note = F.concat(prefix, F.lit(" "), "key", F.lit(": "), "message")
    return failed.select(order.alias("at"), "source", "key", note.alias("note")).orderBy("at", "key")


def notes_of(outcomes: DataFrame, most: int = C.MAX_NOTES) -> list[str]:
    """Notes for the run log; of very many failures the first ones and how many more there are.

    The table of pulls keeps them all.
    """
    notes = failed_notes(outcomes)
    found = [r.note for r in notes.limit(most + 1).collect()]
    if len(found) <= most:
        return found
    return [*found[:most], f"and {notes.count() - most} more failed pulls"]


def failed_search_hosts(outcomes: DataFrame, most: int = C.MAX_NOTES) -> list[str]:
    """Hosts of which any search pull failed, for the digest."""
    failed = outcomes.where((F.col("ok") == 0) & F.col("source").isin(list(SEARCH)))
    return [r.key for r in failed.select("key").distinct().orderBy("key").limit(most).collect()]
