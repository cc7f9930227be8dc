"""Rules with their default thresholds, and the site list as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidegauge import constants as C


@dataclass(frozen=True)
class FloodRules:
    min_visits: int = C.FLOOD_MIN_VISITS
    multiple: float = C.FLOOD_MULTIPLE
    flat_pages: float = C.FLAT_PAGES_PER_SESSION
    direct_share: float = C.DIRECT_SHARE


@dataclass(frozen=True)
class OpportunityRules:
    target_position: float = C.TARGET_POSITION
    snippet_max_position: float = C.SNIPPET_MAX_POSITION
    rank_max_position: float = C.RANK_MAX_POSITION
    min_impressions: int = C.OPPORTUNITY_MIN_IMPRESSIONS
    ctr_ratio: float = C.SNIPPET_CTR_RATIO
    min_clicks: float = C.MIN_ACTIONABLE_CLICKS


@dataclass(frozen=True)
class SignalRules:
    min_change: int = C.SIGNAL_MIN_ABSOLUTE_CHANGE
    rise_delta: float = C.RISE_MIN_DELTA
    drop_delta: float = C.DROP_MAX_DELTA
    subflood_delta: float = C.SUBFLOOD_MIN_DELTA
    subflood_change: int = C.SUBFLOOD_MIN_ABSOLUTE_CHANGE
    subflood_visits: int = C.SUBFLOOD_MIN_VISITS
    subflood_flat_pages: float = C.FLAT_PAGES_PER_SESSION
    subflood_direct_share: float = C.SUBFLOOD_DIRECT_SHARE
    subflood_top_page_share: float = C.SUBFLOOD_TOP_PAGE_SHARE
    error_days: int = C.ERROR_BASELINE_DAYS
    error_min_days: int = C.ERROR_MIN_BASELINE_DAYS
    error_multiple: float = C.ERROR_SPIKE_MULTIPLE
    error_points: float = C.ERROR_SPIKE_POINTS
    error_min_share: float = C.ERROR_MIN_SHARE
    error_min_requests: int = C.ERROR_MIN_REQUESTS
    malformed_min_paths: int = C.MALFORMED_MIN_PATHS


@dataclass(frozen=True)
class Site:
    """One reported site. ``measurement`` is "rum" (sessions) or "zone" (requests)."""

    host: str
    also_hosts: tuple[str, ...] = ()
    search_property: str | None = None
    page_filter: str | None = None
    exclude_paths: tuple[str, ...] = ()
    measurement: str = "rum"
    deny_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class SiteConfig:
    """The configured sites and forums; every table is built from this list."""

    sites: tuple[Site, ...]
    forums: tuple[tuple[str, str], ...] = field(default_factory=tuple)  # (host, name)
    accounts: tuple[str, ...] = ()  # accounts whose beacons are added up; a run needs all of them

    def __post_init__(self):
        for site in self.sites:
            if site.measurement not in ("rum", "zone"):
                raise ValueError(f"unknown measurement class {site.measurement!r} for {site.host}")

    def hosts(self, measurement: str | None = None) -> list[str]:
        return [s.host for s in self.sites if measurement in (None, s.measurement)]

    def sites_df(self, spark: SparkSession) -> DataFrame:
        rows = [(s.host, s.measurement, s.search_property) for s in self.sites]
        return local_table(spark, rows, "host measurement property")

    def aliases_df(self, spark: SparkSession) -> DataFrame:
        rows = {name: s.host for s in self.sites for name in (s.host, *s.also_hosts)}
        return local_table(spark, list(rows.items()), "alias host")

    def exclude_df(self, spark: SparkSession) -> DataFrame:
        rows = [(s.host, path) for s in self.sites for path in s.exclude_paths]
        return local_table(spark, rows, "host path")

    def page_filters(self) -> dict[str, str]:
        return {s.host: s.page_filter for s in self.sites if s.page_filter}

    def deny(self, spark: SparkSession) -> dict[str, list[str]]:
        """Deny patterns that compile, by host; one that does not compile denies nothing."""
        valid = {p for p in {p for s in self.sites for p in s.deny_patterns} if compiles(spark, p)}
        found = {s.host: [p for p in s.deny_patterns if p in valid] for s in self.sites}
        return {host: patterns for host, patterns in found.items() if patterns}

    def forums_df(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, list(self.forums), "host name")


def local_table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Config rows as a local relation of string columns.

    Spark knows the exact size of a local relation, so a join against it is a
    broadcast below ``spark.sql.autoBroadcastJoinThreshold`` and a shuffle above;
    no hint is given.
    """
    columns = names.split()
    values = list(zip(*rows)) or [()] * len(columns)
    arrays = [pa.array(list(column), pa.string()) for column in values]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=columns))


def compiles(spark: SparkSession, pattern: str) -> bool:
    try:
        spark.sql("SELECT rlike('', :pattern)", args={"pattern": pattern}).collect()
    except PySparkException:
        return False
    return True
