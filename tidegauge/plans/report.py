"""The report of a period, as one set of lazy DataFrames over the daily tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge import schemas as S
from tidegauge.config import FloodRules, OpportunityRules, SignalRules, SiteConfig
from tidegauge.functions.ranking import exact_median
from tidegauge.operators import digest as D
from tidegauge.operators import floods as E
from tidegauge.operators import forums as K
from tidegauge.operators import opportunities as O
from tidegauge.operators import reads as R
from tidegauge.operators import signals as H
from tidegauge.operators import sites as P
from tidegauge.operators import totals as T
from tidegauge.operators import zone as Z
from tidegauge.sinks.scratch import pinned
from tidegauge.sources.manifest import latest
from tidegauge.sources.tables import read_table

KEYS = ["as_of", "host"]


@dataclass
class Tables:
    """The daily tables by name; a table that is not given reads as empty.

    A table may be given as a function, which is called when the table is first
    asked for: a report then plans only the tables that it reads.
    """

    spark: SparkSession
    frames: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)

    @classmethod
    def stored(cls, spark: SparkSession, root: str) -> Tables:
        """All tables as they are now, also if a later run writes some of them."""
        state = latest(spark, root)
        return cls(spark, {name: partial(read_table, spark, root, name, state) for name in S.TABLES})

    def __getitem__(self, name: str) -> DataFrame:
        frame = self.frames.get(name)
        if frame is None:
            frame = self.spark.createDataFrame([], S.TABLES[name])
        elif callable(frame):
            frame = frame()
        self.frames[name] = frame
        return frame


def folded(lists: Mapping[str, tuple], singles: Mapping[str, DataFrame]) -> DataFrame:
    """Cards (rows per site, and the columns of an entry) and single rows per site, as one row
    per site: a sorted list of each card (null where it is empty), the columns of each single row.

    Rows of all kinds are stacked, with one column of entries each, and meet in one grouping.
    """
    stacked = [card.select(*KEYS, F.struct(*columns).alias(name)) for name, (card, *columns) in lists.items()]
    own = {name: [c for c in row.columns if c not in KEYS] for name, row in singles.items()}
    stacked += [row.select(*KEYS, F.struct(*own[name]).alias(name)) for name, row in singles.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    entries = [F.collect_list(name).alias(name) for name in lists]
    grouped = whole.groupBy(*KEYS).agg(*entries, *[F.max(name).alias(name) for name in singles])
    return grouped.select(
        *KEYS,
        *[F.when(F.size(name) > 0, F.sort_array(name)).alias(name) for name in lists],
        *[F.col(f"{name}.{c}").alias(c) for name in singles for c in own[name]],
    )


@dataclass
class Report:
    """Every panel of a report. ``periods`` is one period, or several report dates."""

    tables: Tables
    config: SiteConfig
    periods: R.Period | Sequence[R.Period]
    flood_rules: FloodRules = FloodRules()
    opportunity_rules: OpportunityRules = OpportunityRules()
    signal_rules: SignalRules = SignalRules()
    domain: str | None = None
    pin: bool = False  # compute the classified days once; for reports of many panels

    @property
    def days(self) -> int:
        period = self.periods if isinstance(self.periods, R.Period) else self.periods[0]
        return period.days

    def _domain(self, df: DataFrame) -> DataFrame:
        return df if self.domain is None else df.where(F.col("host") == self.domain)

    def rows(self, name: str, first: str = "history_start") -> DataFrame:
        return self._domain(R.within(self.tables[name], self.periods, first))

    def selected(self, name: str, first: str = "history_start") -> DataFrame:
        """Rows of the selected sites alone; a table may hold hosts that are no longer configured."""
        return self.rows(name, first).join(self.sites.select(*KEYS), KEYS, "left_semi")

    # ------------------------------------------------------------- base frames

    @cached_property
    def sites(self) -> DataFrame:
        """Selected sites, once per report date."""
        periods = [self.periods] if isinstance(self.periods, R.Period) else self.periods
        dates = F.array(*[F.lit(p.date) for p in periods])
        sites = self.config.sites_df(self.tables.spark)
        return self._domain(sites).select("host", "measurement", F.explode(dates).alias("as_of"))

    @cached_property
    def kinds(self) -> DataFrame:
        """Sessions by channel. Grouped before the days are given to their report dates."""
        by_day = R.kinds_by_day(self._domain(self.tables["referrers"]))
        return R.within(by_day, self.periods)

    @cached_property
    def split(self) -> DataFrame:
        """Classified and split days of the whole history, per report date."""
        if isinstance(self.periods, R.Period) or len({p.days for p in self.periods}) > 1:
            classified = E.classify_floods(self.rows("traffic"), self.kinds, self.flood_rules)
        else:
            # One pass over the stored days, however many report dates there are.
            traffic, kinds = self._domain(self.tables["traffic"]), R.kinds_by_day(self._domain(self.tables["referrers"]))
            dates = [p.date for p in self.periods]
            history = (self.periods[0].date - self.periods[0].history_start).days + 1
            hosts = self.sites.select("host").distinct()
            classified = E.classify_many(traffic, kinds, hosts, dates, history, self.flood_rules)
        split = E.split_days(classified)
        return pinned(split) if self.pin else split

    @cached_property
    def floods(self) -> DataFrame:
        return E.flood_dates(self.split)

    @cached_property
    def period_referrers(self) -> DataFrame:
        return self.rows("referrers", "start")

    @cached_property
    def referrers(self) -> DataFrame:
        return P.merge_referrers(self.period_referrers, self.floods)

    @cached_property
    def landing(self) -> DataFrame:
        return P.merge_landing(self.rows("landing", "start"), self.floods)

    @cached_property
    def keywords(self) -> DataFrame:
        return self.selected("keywords", "date")

    @cached_property
    def search_pages(self) -> DataFrame:
        return self.selected("search_pages", "date")

    @cached_property
    def search_history(self) -> DataFrame:
        return self.selected("search_summary")

    @cached_property
    def search_latest(self) -> DataFrame:
        return self.selected("search_summary", "date")

    @cached_property
    def statuses(self) -> DataFrame:
        return self.rows("zone_status")

    # ------------------------------------------------------------- site panels

    @cached_property
    def traffic(self) -> DataFrame:
        """One row per selected site with both periods and the rates."""
        measured = P.site_traffic(self.split, self.days)
        filled = self.sites.join(measured, KEYS, "left")
        return P.with_rates(filled.fillna(0, [c for c in measured.columns if c not in KEYS]))

    @cached_property
    def sources(self) -> DataFrame:
        sources = P.site_sources(self.referrers, self.traffic)
        return sources.join(self.sites, KEYS)

    @cached_property
    def opportunities(self) -> DataFrame:
        return O.opportunities(self.keywords, self.config.deny(self.tables.spark), self.opportunity_rules)

    @cached_property
    def opportunity_facts(self) -> DataFrame:
        return O.opportunity_facts(self.opportunities)

    @cached_property
    def landing_card(self) -> DataFrame:
        return P.landing_card(self.landing)

    @cached_property
    def site_rows(self) -> DataFrame:
        """The report of every site, one row each, without its lists."""
        keys = KEYS
        summary = P.site_search_summary(self.sites, self.search_latest).withColumnsRenamed(
            {c: f"search_{c}" for c in ("clicks", "impressions", "ctr", "position")}
        )
        counts = self.opportunity_facts.select(*keys, "snippet_count", "rank_count")
        labels = P.window_label(self.search_latest, self.keywords, self.search_pages)
        joined = (
            self.traffic.join(self.sources.drop("measurement"), keys)
            .join(P.latest_anomaly(self.split), keys, "left")
            .join(summary, keys)
            .join(labels, keys, "left")
            .join(counts, keys, "left")
        )
        return joined.fillna(0, ["snippet_count", "rank_count"]).withColumn(
            "opportunity_count", F.col("snippet_count") + F.col("rank_count")
        )

    # ----------------------------------------------------------------- signals

    def facts(self, rules: Sequence[str] = H.ALL_RULES) -> DataFrame:
        """One row per site with what the given rules need, and nothing else."""
        facts = self.traffic
        wanted = set(rules)
        if wanted & {"likely-bot-subflood", "traffic-rise"}:
            facts = facts.join(self.sources.select(*KEYS, "direct"), KEYS)
        if wanted & {"likely-bot-subflood", "traffic-rise", "malformed-urls"}:
            facts = facts.join(H.landing_facts(self.landing_card), KEYS, "left")
        if wanted & {"snippet-gap", "rank-gap"}:
            facts = facts.join(self.opportunity_facts, KEYS, "left")
        if "no-comparison" in wanted:
            facts = facts.join(E.flood_run(self.floods), KEYS, "left")
        if "error-spike" in wanted:
            series = H.error_series(self.statuses, self.rows("traffic"))
            facts = facts.join(H.error_facts(series, self.signal_rules), KEYS, "left")
        return facts

    def signals(self, rules: Sequence[str] = H.ALL_RULES) -> DataFrame:
        return H.signals(self.facts(rules), self.signal_rules, self.days, rules)

    @cached_property
    def ranked_signals(self) -> DataFrame:
        """All signals with their place among those of the report date."""
        order = [F.col("severity"), F.desc("weight"), F.col("host"), F.col("rule_order")]
        place = F.row_number().over(W.partitionBy("as_of").orderBy(*order))
        return self.signals().withColumn("place", place)

    # ------------------------------------------------------------------ totals

    def by_period(self, make: Callable[[Report], DataFrame]) -> DataFrame:
        """A panel over all sites. Of several report dates, each has its own, tagged ``as_of``."""
        if isinstance(self.periods, R.Period):
            return make(self)
        dated = [make(replace(self, periods=p)).withColumn("as_of", F.lit(p.date)) for p in self.periods]
        return reduce(DataFrame.unionByName, dated)

    @cached_property
    def totals(self) -> DataFrame:
        """One row (per report date) with every total over all selected sites.

        All totals are declared over six kinds of rows and folded into one grouping; the
        median needs passes of its own over the keywords. Several report dates are groups.
        """
        keys = [] if isinstance(self.periods, R.Period) else ["as_of"]
        zone = {c: f"zone_{c}" for c in ("visits", "requests", "bytes", "sites", "hosts")}
        named = {"snippet": "snippet_opportunities", "rank": "rank_opportunities"}

        def renamed(columns: list, names: Mapping[str, str]) -> list:
            return [c.alias(new) for c, new in zip(columns, names.values(), strict=True)]

        keywords = O.classify_keywords(self.keywords, self.config.deny(self.tables.spark), self.opportunity_rules)
        often = self.keywords.where(T.seen_often())
        rows = {
            "site": self.traffic.join(self.sources.drop("measurement"), KEYS),
            "internal": T.internal_rows(self.period_referrers, self.sites),
            "search": self.search_latest,
            # The class goes through a generator, so that its expressions are not written out in every total.
            "keyword": keywords.withColumn("kind", F.explode_outer(F.array("kind"))),
            "middle": exact_median(often, "position", keys),
            "trend": T.last_dates(T.traffic_trend(self.split, self.kinds, self.sites, keys), keys=keys),
            "snapshot": T.last_dates(T.search_trend(self.search_history, keys), keys=keys),
        }
        site, search, keyword = T.of("site"), T.of("search"), T.of("keyword")
        totals = {
            "rum": T.rum_columns(site), "mix": T.mix_columns(site), "counts": T.count_columns(site),
            "zone": renamed(T.zone_columns(site), zone),
            "internal": [(F.count("internal") > 0).alias("internal_measured")],
            "search": T.search_columns(search),
            "positions": T.position_columns(keyword), "sample": T.sample_columns(keyword),
            "median": [F.coalesce(F.max("middle.median"), F.lit(0.0)).alias("median_position")],
            "opportunities": renamed(O.opportunity_columns(keyword), {"opportunities": "opportunities", **named}),
            "trend": T.trend_columns(T.of("trend")), "snapshots": T.snapshot_columns(T.of("snapshot")),
        }
        return T.with_ratios(T.with_sample_share(T.folded(rows, totals, keys), "impressions"))

    @cached_property
    def traffic_trend(self) -> DataFrame:
        return self.by_period(lambda r: T.last_dates(T.traffic_trend(r.split, r.kinds, r.sites)))

    @cached_property
    def search_trend(self) -> DataFrame:
        return self.by_period(lambda r: T.last_dates(T.search_trend(r.search_history)))

    @cached_property
    def coverage(self) -> DataFrame:
        """Stored days of the period and the one before, first day, and a note when days are missing."""
        def of(r: Report) -> DataFrame:
            found = R.dates_available(self.tables["traffic"], r.periods)
            return found.withColumn("note", T.coverage_note("days_available", r.days))

        return self.by_period(of)

    @cached_property
    def forums(self) -> DataFrame:
        """Activity of every configured forum."""
        forums = self.config.forums_df(self.tables.spark)
        return self.by_period(lambda r: K.forum_report(forums, R.within(r.tables["forums"], r.periods)))

    @cached_property
    def digest(self) -> DataFrame:
        return self.by_period(lambda r: D.daily_digest(r.split, r.sites))

    @cached_property
    def digest_ranked(self) -> DataFrame:
        return self.by_period(lambda r: D.digest_ranked(r.split, r.sites))

    def run_result(self, notes: Sequence[str] = (), failed_hosts: Sequence[str] = ()) -> DataFrame:
        """Outcome of the nightly run of the report date, one row."""
        if not isinstance(self.periods, R.Period):
            raise ValueError("a run has one date")
        today = self.rows("traffic", "date").join(self.sites.select(*KEYS), KEYS, "left_semi")
        alert = H.top_alert(self.signals())
        date = F.lit(self.periods.date)
        return D.run_result(today, self.digest, alert, date, tuple(notes), tuple(failed_hosts))

    # ------------------------------------------------------------------ export

    def export(self) -> DataFrame:
        """Nested report per site. Lists are card rows, at most a dozen per site.

        All cards are stacked and grouped by site once; only the result joins the site rows.
        """
        search = ("clicks", "impressions", "ctr", "position")
        zone_sites = self.sites.where(F.col("measurement") == "zone").select(*KEYS)
        statuses = self.rows("zone_status", "date")
        lists = {
            "referrers": (P.referrer_card(self.referrers), "rank", "referrer", "kind", "visits"),
            "landing": (self.landing_card, "rank", "page", "visits", "views"),
            "files": (P.file_card(self.rows("zone_pages", "start")), "rank", "page", "requests", "zone_visits"),
            "keywords": (P.keyword_card(self.keywords), "rank", "query", *search),
            "pages": (P.search_page_card(self.search_pages), "rank", "page", *search),
            "countries": (P.country_card(self.rows("zone_countries", "date")), "rank", "country", "visits"),
            "statuses": (P.status_card(statuses), "rank", "status", "requests"),
            "spark": (P.sparkline(self.split), "date", "visits", "flood"),
        }
        singles = {
            "verified": Z.verified_bots(self.rows("zone_bots", "date"), zone_sites),
            "noise": Z.non_content_totals(self.rows("zone_pages", "date"), statuses),
        }
        return self.site_rows.join(folded(lists, singles), KEYS, "left")

    def document(self) -> DataFrame:
        """The whole report as JSON documents: (as_of, part, host, body), a row per entry.

        Parts are totals, coverage, run, traffic_trend, search_trend, signal (in order of
        their rank in the body), forum, site, opportunity and verified_category. Entries
        stay rows, so that no part is gathered in one task.
        """
        parts = {
            "totals": self.totals,
            "coverage": self.coverage,
            "run": self.tables["runs"].orderBy(F.desc("run_at")).limit(1),
            "traffic_trend": self.traffic_trend,
            "search_trend": self.search_trend,
            "signal": self.ranked_signals,
            "forum": self.forums,
            "site": self.export(),
            "opportunity": O.rank_opportunities(self.opportunities),
            "verified_category": Z.verified_categories(self.rows("zone_bots", "date").join(self.sites.select(*KEYS), KEYS, "left_semi")),
        }
        only = self.periods.date if isinstance(self.periods, R.Period) else None
        rows = []
        for name, part in parts.items():
            as_of = F.col("as_of") if "as_of" in part.columns else F.lit(only).cast("date")
            host = F.col("host") if "host" in part.columns else F.lit(None).cast("string")
            body = F.to_json(F.struct(*[c for c in part.columns if c != "as_of"]))
            rows.append(part.select(as_of.alias("as_of"), F.lit(name).alias("part"), host.alias("host"), body.alias("body")))
        return reduce(DataFrame.unionByName, rows)
