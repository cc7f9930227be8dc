"""Nightly ingest: landed groups in, stored daily tables out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge import schemas as S
from tidegauge.config import SiteConfig
from tidegauge.operators import ingest, pulls
from tidegauge.operators import signals as H
from tidegauge.operators.reads import Period
from tidegauge.plans.report import Report, Tables
from tidegauge.sinks import daily
from tidegauge.sinks.scratch import cleared, staged
from tidegauge.sources import landed as sources


@dataclass(frozen=True)
class Landed:
    """Flat source rows of a run; a source that was not pulled is None.

    ``outcomes`` (date, source, key, ok, message) says which pulls were good. Without it all
    rows are taken to be whole.
    """

    beacons: DataFrame | None = None
    zone_log: DataFrame | None = None  # request rows with all their dimensions
    keywords: DataFrame | None = None
    search_pages: DataFrame | None = None
    search_summary: DataFrame | None = None
    forums: DataFrame | None = None
    zone_groups: DataFrame | None = None  # the request log as groups by one dimension each (read_zone)
    outcomes: DataFrame | None = None

    @classmethod
    def read(
        cls, spark: SparkSession, config: SiteConfig, paths: Mapping[str, str | Sequence[str]], start: dt.date, end: dt.date
    ) -> Landed:
        """Responses below ``paths`` (by source) and what became of every pull that the run needs."""
        days = [start + dt.timedelta(n) for n in range((end - start).days + 1)]
        found = [sources.outcomes(spark, source, path) for source, path in paths.items()]
        made = reduce(DataFrame.unionByName, found).where(F.col("date").between(F.lit(start), F.lit(end)))
        made = staged(made, "outcomes")
        accounts = [r.key for r in made.where("source = 'beacons'").select("key").distinct().collect()] or ["1"]
        expected = pulls.expected_pulls(spark, config, list(paths), days, accounts)
        rows = {FIELDS.get(source, source): READERS[source](spark, path) for source, path in paths.items()}
        return cls(**rows, outcomes=sources.settled(made, expected))


READERS = {
    "beacons": sources.read_beacons, "zone": sources.read_zone, "keywords": sources.read_keywords,
    "search_pages": sources.read_search_pages, "search_summary": sources.read_search_summary, "forums": sources.read_forums,
}
FIELDS = {"zone": "zone_groups"}
# The sources that fill each table. Traffic has the sites of both measurements.
FED_BY = {
    "traffic": ("beacons", "zone"), **dict.fromkeys(("referrers", "landing"), ("beacons",)),
    **dict.fromkeys(("zone_pages", "zone_countries", "zone_status", "zone_bots"), ("zone",)),
    **{name: (name,) for name in ("keywords", "search_pages", "search_summary", "forums")},
}
SCOPES = {
    "traffic": "TRUE",
    **dict.fromkeys(("referrers", "landing"), "measurement = 'rum'"),
    **dict.fromkeys(("zone_pages", "zone_countries", "zone_status", "zone_bots"), "measurement = 'zone'"),
    **dict.fromkeys(("keywords", "search_pages", "search_summary"), "property IS NOT NULL"),
}


def daily_tables(
    spark: SparkSession, config: SiteConfig, landed: Landed, start: dt.date, end: dt.date
) -> dict[str, DataFrame]:
    """Every daily table that the run can fill, whole: lists are cut where a card is drawn.

    Of each raw source the dates of the run are read, once: its rollup with grouping
    sets is written to the shared folder, and the tables are taken from that far
    smaller result.
    """
    tables: dict[str, DataFrame] = {}
    totals, measured = [], []

    def of_the_run(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("date").between(F.lit(start), F.lit(end)))

    if landed.beacons is not None:
        measured.append("rum")
        known = ingest.resolve_hosts(of_the_run(landed.beacons), config.aliases_df(spark))
        counted = ingest.drop_excluded(known, config.exclude_df(spark))
        rolled = staged(ingest.beacon_rollup(counted), "beacons", "section")
        totals.append(
            ingest.beacon_traffic(rolled).withColumn("bytes", F.lit(0).cast("long"))
        )
        referrers = ingest.section(rolled, "referrers", "referrer", "visits")
        tables["referrers"] = ingest.with_kind(referrers, config.aliases_df(spark))
        tables["landing"] = ingest.section(rolled, "landing", "page", "visits", "views")
    if landed.zone_log is not None and landed.zone_groups is not None:
        raise ValueError("the request log was landed in both forms, which would count it twice")
    if landed.zone_log is not None or landed.zone_groups is not None:
        measured.append("zone")
        if landed.zone_log is not None:
            rolled = ingest.zone_rollup(of_the_run(landed.zone_log))
        else:
            rolled = ingest.zone_rollup_from_groups(of_the_run(landed.zone_groups))
        rolled = staged(rolled, "zone", "section")
        totals.append(ingest.zone_traffic(rolled))
        tables["zone_pages"] = ingest.zone_paths(rolled)
        tables["zone_countries"] = ingest.section(rolled, "zone_countries", "country", "visits")
        tables["zone_status"] = ingest.section(rolled, "zone_status", "status", "requests")
        tables["zone_bots"] = ingest.section(rolled, "zone_bots", "category", "requests", "visits")
    if totals:
        traffic = totals[0] if len(totals) == 1 else totals[0].unionByName(totals[1])
        # A source that was not pulled says nothing of its sites: their rows stay as stored.
        pulled = config.sites_df(spark).where(F.col("measurement").isin(measured))
        tables["traffic"] = ingest.fill_sites(traffic, pulled, start.isoformat(), end.isoformat())
    for name in ("keywords", "search_pages", "search_summary", "forums"):
        rows = getattr(landed, name)
        if rows is not None:
            if name == "search_pages":
                rows = sources.filter_pages(rows, config.page_filters())
            tables[name] = of_the_run(rows).select(*S.TABLES[name].fieldNames())
    return tables


def record_signals(
    batch: daily.Batch, config: SiteConfig, dates: Sequence[dt.date], tables: Tables | None = None,
    only: Sequence[str] = H.ALL_RULES, escalate_at: int = C.ESCALATE_RECURRENCE, **rules,
) -> None:
    """Store the signals of consecutive report dates with their recurrence.

    Of the history only the date before the first one is read; a later correction of a date
    is followed by recording it and the dates after it again.
    """
    tables = tables or Tables(batch.spark, {name: partial(batch.read, name) for name in S.TABLES})
    periods = [Period(d) for d in sorted(dates)]
    found = Report(tables, config, periods[0] if len(periods) == 1 else periods, **rules).signals(only)
    before = batch.read("signals").where(F.col("date") == F.lit(periods[0].date - dt.timedelta(1)))
    rows = H.recurrence(found, escalate_at, before).withColumn("date", F.col("as_of")).select(*S.TABLES["signals"].fieldNames())
    batch.replace_scope("signals", rows, daily.refresh_scope(config.sites_df(batch.spark), [p.date for p in periods]))


def run_nightly(
    spark: SparkSession,
    root: str,
    config: SiteConfig,
    landed: Landed,
    start: dt.date,
    end: dt.date,
    run_at: dt.datetime,
    notes: Sequence[str] = (),
    failed_hosts: Sequence[str] = (),
    history: bool = True,
) -> DataFrame:
    """Fill the daily tables for the dates of a run, record it, and give its result.

    All tables, the outcomes of the pulls and the record of the run become visible together,
    or, after a failure, none of them. Hosts and dates whose pull failed are left out of every
    scope, so their stored rows stay; each is noted. A source that was not pulled touches
    nothing. With ``history`` the signals of the last date are stored as well. The result (one row: sessions of the last date, first alert, notes) is computed
    from the stored tables when it is asked for.
    """
    days = [start + dt.timedelta(n) for n in range((end - start).days + 1)]
    sites = config.sites_df(spark)
    notes, failed_hosts = list(notes), list(failed_hosts)
    with cleared(spark), daily.Batch(spark, root) as batch:
        outcomes = landed.outcomes
        if outcomes is not None:
            outcomes = staged(outcomes, "pulls")
            batch.upsert("pulls", outcomes)
            notes += pulls.notes_of(outcomes)
            failed_search = pulls.failed_search_hosts(outcomes)
        else:
            failed_search = failed_hosts
        for name, rows in daily_tables(spark, config, landed, start, end).items():
            good = None
            if outcomes is not None:
                pairs = [pulls.good_pairs(outcomes, source, sites) for source in FED_BY[name]]
                good = reduce(DataFrame.unionByName, pairs)
            if name == "forums":
                known = rows if good is None else rows.join(good, ["date", "host"], "left_semi")
                batch.upsert(name, known)
                continue
            # Only the sites that a table's source measures are in its scope.
            scope = daily.refresh_scope(sites.where(SCOPES[name]), days, True, failed_hosts, good)
            if name == "traffic":
                batch.upsert(name, rows.join(scope, ["date", "host"], "left_semi"))
            else:
                batch.replace_scope(name, rows, scope)
        if history:
            record_signals(batch, config, [end])
        batch.log_run(run_at, end, notes)
    failed = sorted({*failed_hosts, *failed_search})
    return Report(Tables.stored(spark, root), config, Period(end)).run_result(notes, failed)
