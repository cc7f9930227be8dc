"""Web-traffic tables derived by Spark from the given ``events``, ``lineitem`` and ``pages``."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.config import FloodRules, SignalRules, Site, SiteConfig
from tidegauge.functions.scalars import ratio, search_window
from tidegauge.operators import ingest as B
from tidegauge.operators.reads import Period
from tidegauge.plans.nightly import Landed, daily_tables
from tidegauge.plans.report import Report, Tables

HOSTS = ["site0.example", "site1.example", "site2.example", "wiki.example", "files.example"]
CONFIG = SiteConfig(
    sites=(
        Site("site0.example", search_property="sc-domain:site0.example", deny_patterns=("^q1", "(")),
        Site("site1.example", also_hosts=("www.site1.example",),
             search_property="sc-domain:site1.example",
             page_filter=r"^https://site1\.example/r/1"),
        Site("site2.example", search_property="sc-domain:site2.example", exclude_paths=("/p/3",)),
        Site("wiki.example", search_property="https://wiki.example/", deny_patterns=("0$",)),
        Site("files.example", measurement="zone"),
    ),
    forums=(("forum0.example", "Forum Zero"), ("forum1.example", "Forum One"),
            ("forum2.example", "Forum Two")),
)
# The same sites and one of which no source has a row.
WITH_IDLE = replace(CONFIG, sites=(*CONFIG.sites, Site("idle.example")))
FIRST = dt.date(2024, 1, 1)
LAST = dt.date(2024, 1, 30)
# Thresholds at which the test tables, which are quiet, show every verdict.
FLOOD_RULES = FloodRules(min_visits=20, multiple=1.5, direct_share=0.6)
NO_FLOODS = FloodRules(min_visits=10**9, multiple=1.5, direct_share=0.6)
SIGNAL_RULES = SignalRules(
    min_change=5, rise_delta=0.10, drop_delta=-0.10, error_min_requests=20,
    subflood_direct_share=0.6, subflood_top_page_share=0.03,
)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.config = CONFIG

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---------------------------------------------------------------- raw rows

    @cached_property
    def events(self) -> DataFrame:
        return self.given("events").select(
            "event_id",
            "ts",
            "user_id",
            "event_type",
            "value",
            F.to_date("ts").alias("date"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def rum(self) -> DataFrame:
        """Beacon rows, resolved to their site; ``raw_host`` may be an alias."""
        kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
        arrives = kind.isin("view", "error")
        host = (
            F.when(F.dayofmonth("date").isin(10, 29, 30) & arrives, "wiki.example")
            .when(user % 5 == 1, "wiki.example")
            .otherwise(F.concat(F.lit("site"), user % 3, F.lit(".example")))
        )
        referer = (
            F.when(arrives, "")
            .when(kind == "click", "www.google.com")
            .when(kind == "purchase", F.when(k % 2 == 0, "old.reddit.com").otherwise("news.example.net"))
            .when(k % 3 == 0, "chatgpt.com")
            .when(k % 3 == 1, "www.site1.example")
            .otherwise("Duckduckgo.com")
        )
        renamed = (F.col("host") == "site1.example") & (F.col("event_id") % 3 == 0)
        return (
            self.events.where(user % 5 != 0)
            .select(
                "event_id",
                "ts",
                "date",
                host.alias("host"),
                referer.alias("referer"),
                F.concat(F.lit("/p/"), k % 25).alias("path"),
                F.lit(1).cast("long").alias("views"),
                F.when(arrives | (kind == "click") | (k % 2 == 0), 1).otherwise(0).cast("long").alias("visits"),
            )
            .withColumn(
                "raw_host", F.when(renamed, "www.site1.example").otherwise(F.col("host"))
            )
        )

    @cached_property
    def beacons(self) -> DataFrame:
        """Beacon rows as a source delivers them: any host name, not yet resolved."""
        return self.rum.drop("host")

    @cached_property
    def counted(self) -> DataFrame:
        known = B.resolve_hosts(self.beacons, self.config.aliases_df(self.spark))
        return B.drop_excluded(known, self.config.exclude_df(self.spark))

    @cached_property
    def zone_log(self) -> DataFrame:
        kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
        error = kind == "error"
        status = (
            F.when(error & (k < 60), 404)
            .when(error & (k < 75), 503)
            .when(error & (k < 80), 406)
            .when((F.dayofmonth("date") == 30) & (kind == "signup"), 404)
            .when((kind == "view") & (k % 3 == 0), 206)
            .otherwise(200)
        )
        path = (
            F.when(k % 10 == 0, "/robots.txt")
            .when(k % 10 == 1, "/favicon.ico")
            .when(k % 10 == 2, "/cdn-cgi/trace")
            .when(k % 10 == 3, "/.well-known/x")
            .when(k % 10 == 4, "/sitemap_index.xml")
            .otherwise(F.concat(F.lit("/books/"), k, F.lit(".pdf")))
        )
        category = (
            F.when(k % 6 == 0, "AI Crawler")
            .when(k % 6 == 1, "Archiver")
            .when(k % 6 == 2, "Search Engine Crawler")
            .otherwise("")
        )
        return self.events.where(user % 5 == 0).select(
            "event_id",
            "ts",
            "date",
            F.lit("files.example").alias("host"),
            F.lit(1).cast("long").alias("requests"),
            F.when(k % 4 == 0, 1).otherwise(0).cast("long").alias("visits"),
            F.floor(F.col("value") * 1000).alias("bytes"),
            status.alias("status"),
            path.alias("path"),
            F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("C"), user % 14)).alias("country"),
            category.alias("category"),
        )

    @cached_property
    def keyword_rows(self) -> DataFrame:
        part = F.col("l_partkey")
        clicked = F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 4))
        impressions = F.greatest(F.col("n") - 18, F.lit(0)) + part % 9
        return (
            self.given("lineitem")
            .groupBy("l_partkey")
            .agg(F.count("*").alias("n"), clicked.alias("clicked"))
            .select(
                F.lit(LAST).alias("date"),
                F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (part % 5 + 1).cast("int")).alias("host"),
                F.concat(F.lit("q"), part).alias("query"),
                "l_partkey",
                F.least(impressions, F.col("clicked")).alias("clicks"),
                impressions.alias("impressions"),
                F.round(1 + (part % 600) / F.lit(10.0), 1).alias("position"),
                search_window(F.lit(LAST)).alias("search_window"),
            )
        )

    @cached_property
    def keywords(self) -> DataFrame:
        return self.keyword_rows.drop("l_partkey")

    @cached_property
    def search_pages(self) -> DataFrame:
        page = F.concat(F.lit("https://"), "host", F.lit("/r/"), F.col("l_partkey") % 200)
        weighted = F.sum(F.col("position") * F.col("impressions"))
        return (
            self.keyword_rows.groupBy("date", "host", page.alias("page"))
            .agg(
                F.sum("clicks").alias("clicks"),
                F.sum("impressions").alias("impressions"),
                F.round(ratio(weighted, F.sum("impressions")), 6).alias("position"),
                F.max("search_window").alias("search_window"),
            )
            .withColumn("ctr", ratio(F.col("clicks"), F.col("impressions")))
        )

    @cached_property
    def search_summary(self) -> DataFrame:
        hosts = F.array(*[F.lit(h) for h in HOSTS])
        host = F.element_at(hosts, (F.col("user_id") % 5 + 1).cast("int"))
        return (
            self.events.groupBy("date", host.alias("host"))
            .agg(
                F.count_if(F.col("event_type") == "click").alias("clicks"),
                F.sum(F.floor(F.col("value") * 10)).alias("impressions"),
                F.round(5 + F.avg("k") / 10, 6).alias("position"),
            )
            .withColumn("ctr", ratio(F.col("clicks"), F.col("impressions")))
            .withColumn("search_window", search_window(F.col("date")))
        )

    @cached_property
    def url_rows(self) -> DataFrame:
        """Host and path of the crawled pages, with some damaged paths among them."""
        url = r"(?i)^https?://([^/?#]+)([^?#]*)"
        path = F.regexp_extract("url", url, 2)
        page = F.col("page_id")
        damaged = (
            F.when(page % 7 == 0, F.concat(path, F.lit("/%3C/span%3E8")))
            .when(page % 11 == 0, F.concat(F.lit("//dup"), page))
            .when(page % 13 == 0, F.lit("/a/%zz"))
            .otherwise(path)
        )
        return self.given("pages").select(
            "page_id", "url", F.regexp_extract("url", url, 1).alias("host"), damaged.alias("path")
        )

    @cached_property
    def forum(self) -> DataFrame:
        kind = F.col("event_type")
        daily = self.events.groupBy(
            "date", F.concat(F.lit("forum"), F.col("user_id") % 2, F.lit(".example")).alias("host")
        ).agg(
            F.countDistinct("user_id").alias("active_today"),
            F.count_if(kind == "signup").alias("new_today"),
            F.count_if(kind == "click").alias("posts_today"),
            F.count_if(kind == "purchase").alias("topics_today"),
        )
        order = W.partitionBy("host").orderBy("date")
        upto = order.rowsBetween(W.unboundedPreceding, 0)

        def last(column: str, n: int):
            return F.sum(column).over(order.rowsBetween(1 - n, 0))

        return daily.select(
            "date",
            "host",
            F.sum("new_today").over(upto).alias("users_count"),
            "active_today",
            last("active_today", 7).alias("active_7d"),
            last("active_today", 30).alias("active_30d"),
            "new_today",
            last("new_today", 7).alias("new_7d"),
            last("new_today", 30).alias("new_30d"),
            "posts_today",
            F.sum("posts_today").over(upto).alias("posts_count"),
            F.sum("topics_today").over(upto).alias("topics_count"),
        )

    # ------------------------------------------------------------ daily tables

    @cached_property
    def zone_rollup(self) -> DataFrame:
        return B.zone_rollup(self.zone_log)

    @cached_property
    def tables(self) -> Tables:
        """The daily tables as lazy plans: a query computes only those it reads."""
        aliases = partial(self.config.aliases_df, self.spark)

        def traffic() -> DataFrame:
            rum = B.host_daily_traffic(self.rum).withColumn("bytes", F.lit(0).cast("long"))
            zone = self.zone_log.groupBy("date", "host").agg(
                F.sum("visits").alias("visits"),
                F.sum("requests").alias("views"),
                F.sum("bytes").alias("bytes"),
            )
            return rum.unionByName(zone)

        def referrers() -> DataFrame:
            return B.with_kind(B.referrer_daily(self.rum), aliases())

        def bots() -> DataFrame:
            return B.section(self.zone_rollup, "zone_bots", "category", "requests", "visits")

        return Tables(
            self.spark,
            {
                "traffic": traffic,
                "referrers": referrers,
                "landing": lambda: B.landing_daily(self.rum),
                "zone_pages": lambda: B.zone_paths(self.zone_rollup),
                "zone_countries": lambda: B.section(self.zone_rollup, "zone_countries", "country", "visits"),
                "zone_status": lambda: B.section(self.zone_rollup, "zone_status", "status", "requests"),
                "zone_bots": bots,
                "keywords": lambda: self.keywords,
                "search_pages": lambda: self.search_pages,
                "search_summary": lambda: self.search_summary,
                "forums": lambda: self.forum,
            },
        )

    def staged_tables(self) -> Tables:
        """The daily tables by way of the nightly plan: each raw source is read once."""
        landed = Landed(
            self.beacons, self.zone_log, self.keywords, self.search_pages, self.search_summary, self.forum
        )
        no_exclusions = SiteConfig(
            tuple(Site(s.host, s.also_hosts, measurement=s.measurement) for s in self.config.sites)
        )
        return Tables(self.spark, daily_tables(self.spark, no_exclusions, landed, FIRST, LAST))

    def full_report(self, days: int = 1) -> Report:
        """A report of many panels: staged tables, and classified days computed once."""
        return self.report(days, tables=self.staged_tables(), pin=True)

    def report(self, days: int = 1, date: dt.date = LAST, rules: FloodRules = FLOOD_RULES,
               tables: Tables | None = None, **extra) -> Report:
        return Report(
            tables or self.tables, self.config, Period(date, days), rules,
            signal_rules=SIGNAL_RULES, **extra,
        )
