"""Report parameters, period bounds and the reads of a report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.config import SiteConfig

PERIODS = (1, 7, 30)
SORTS = ("traffic", "change", "name")


@dataclass(frozen=True)
class ReportParams:
    period_days: int = 1
    domain: str | None = None
    sort: str = "traffic"


def report_params(config: SiteConfig, period_days=1, domain=None, sort="traffic") -> ReportParams:
    """Valid parameters; anything not offered falls back to the default."""
    return ReportParams(
        period_days if period_days in PERIODS else 1,
        domain if domain in config.hosts() else None,
        sort if sort in SORTS else "traffic",
    )


def select_domain(df: DataFrame, params: ReportParams) -> DataFrame:
    return df if params.domain is None else df.where(F.col("host") == params.domain)


@dataclass(frozen=True)
class Period:
    """Bounds of a report: literal dates, so that reads prune partitions."""

    date: dt.date
    days: int = 1

    @property
    def start(self) -> dt.date:
        return self.date - dt.timedelta(self.days - 1)

    @property
    def previous_end(self) -> dt.date:
        return self.start - dt.timedelta(1)

    @property
    def previous_start(self) -> dt.date:
        return self.previous_end - dt.timedelta(self.days - 1)

    @property
    def history_start(self) -> dt.date:
        """Far enough back for a flood baseline and for the comparison period."""
        return min(self.previous_start, self.date - dt.timedelta(C.HISTORY_DAYS - 1))


def period_windows(dates: DataFrame, days: Sequence[int] = PERIODS) -> DataFrame:
    """The same bounds as columns, for a DataFrame of report dates."""
    p = F.col("period_days")
    return (
        dates.select("date", F.explode(F.array(*[F.lit(d) for d in days])).alias("period_days"))
        .withColumn("start", F.date_sub("date", p - 1))
        .withColumn("previous_end", F.date_sub("start", 1))
        .withColumn("previous_start", F.date_sub("previous_end", p - 1))
        .withColumn(
            "history_start",
            F.least("previous_start", F.date_sub("date", C.HISTORY_DAYS - 1)),
        )
    )


def within(
    df: DataFrame,
    periods: Period | Sequence[Period],
    first: str = "history_start",
    last: str = "date",
) -> DataFrame:
    """Rows between two bounds of the period, tagged with the report date ``as_of``.

    With several periods a row appears once per report that it belongs to: the
    stored tables are small and the copies are bounded by the number of reports.
    """
    if isinstance(periods, Period):
        low, high = getattr(periods, first), getattr(periods, last)
        return df.where(F.col("date").between(F.lit(low), F.lit(high))).withColumn(
            "as_of", F.lit(periods.date)
        )
    bounds = F.array(
        *[
            F.struct(
                F.lit(p.date).alias("as_of"),
                F.lit(getattr(p, first)).alias("low"),
                F.lit(getattr(p, last)).alias("high"),
            )
            for p in periods
        ]
    )
    low = min(getattr(p, first) for p in periods)
    high = max(getattr(p, last) for p in periods)
    served = F.filter(bounds, lambda b: F.col("date").between(b["low"], b["high"]))
    return df.where(F.col("date").between(F.lit(low), F.lit(high))).withColumn(
        "as_of", F.explode(F.transform(served, lambda b: b["as_of"]))
    )


def latest(df: DataFrame, periods: Period | Sequence[Period]) -> DataFrame:
    """Rows of the report date alone."""
    return within(df, periods, "date", "date")


def kinds_by_day(referrers: DataFrame) -> DataFrame:
    keys = [c for c in ("as_of", "date", "host", "kind") if c in referrers.columns]
    return referrers.groupBy(*keys).agg(F.sum("visits").alias("visits"))


def referrers_by_day(referrers: DataFrame) -> DataFrame:
    keys = [c for c in ("as_of", "date", "host", "referrer", "kind") if c in referrers.columns]
    return referrers.groupBy(*keys).agg(F.sum("visits").alias("visits"))


def by_clicks(rows: DataFrame, key: str) -> DataFrame:
    return rows.orderBy(F.desc("clicks"), F.desc("impressions"), "host", key)


def dates_available(traffic: DataFrame, period: Period) -> DataFrame:
    """Stored dates in both periods over all hosts, and the first one of this period.

    Dates are made distinct before they are counted; there are at most 60.
    """
    dates = (
        traffic.where(F.col("date").between(F.lit(period.previous_start), F.lit(period.date)))
        .select("date")
        .distinct()
    )
    current = F.col("date") >= F.lit(period.start)
    return dates.agg(
        F.count_if(current).alias("days_available"),
        F.count_if(~current).alias("previous_days_available"),
        F.coalesce(F.min(F.when(current, F.col("date"))), F.lit(period.date)).alias(
            "coverage_start"
        ),
    )
