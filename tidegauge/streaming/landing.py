"""Incremental pick-up of newly landed responses, of every source.

Responses are counted by source and event-time day, with a watermark. What a batch adds to a
day makes that day come out of it, and only then: these are the days to build again, each as
a whole from everything landed for it, so a late correction is a re-run of its day and a batch
that is tried again changes nothing. The state is one row per source and day that the watermark
still holds open; a response for a day before that is too late and rebuilds nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge import schemas as S
from tidegauge.config import SiteConfig
from tidegauge.plans.nightly import Landed, run_nightly
from tidegauge.sources.landed import SOURCES

#: How long a day stays open for late responses.
DELAY = "7 days"


def landed_stream(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(source, day) of every response that lands below ``paths`` (by source)."""
    parts = []
    for source, path in paths.items():
        schema = f"{SOURCES[source][0]}, {S.RESPONSE_ERRORS}, date DATE"
        stream = spark.readStream.schema(schema).json(path)
        parts.append(stream.select(F.lit(source).alias("source"), F.to_timestamp("date").alias("day")))
    return reduce(DataFrame.unionByName, parts)


def changed_days(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Responses by source and day; in update mode a batch gives the days that it has changed."""
    day = F.window("day", "1 day")
    counted = stream.withWatermark("day", delay).groupBy("source", day).agg(F.count("*").alias("responses"))
    return counted.select("source", F.to_date("window.start").alias("date"), "responses")


def on_changed_days(
    spark: SparkSession,
    paths: Mapping[str, str],
    checkpoint: str,
    rebuild: Callable[[dict[str, list[dt.date]]], None],
    delay: str = DELAY,
) -> StreamingQuery:
    """Call ``rebuild`` once per batch with the days, by source, that have new responses.

    Processes all files present and stops (``availableNow``), as a nightly job does.
    """

    def handle(batch: DataFrame, _epoch: int) -> None:
        days: dict[str, list[dt.date]] = {}
        for row in batch.select("source", "date").distinct().orderBy("source", "date").collect():
            days.setdefault(row.source, []).append(row.date)
        if days:
            rebuild(days)

    return (
        changed_days(landed_stream(spark, paths), delay)
        .writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rebuild_days(
    spark: SparkSession, root: str, config: SiteConfig, paths: Mapping[str, str | Sequence[str]], run_at: Callable[[], dt.datetime]
) -> Callable[[dict[str, list[dt.date]]], None]:
    """A ``rebuild`` that runs the nightly ingest for each changed day, of its changed sources."""

    def rebuild(days: dict[str, list[dt.date]]) -> None:
        for date in sorted({d for own in days.values() for d in own}):
            own = {source: paths[source] for source, dates in days.items() if date in dates}
            run_nightly(spark, root, config, Landed.read(spark, config, own, date, date), date, date, run_at())

    return rebuild


def on_new_dates(
    spark: SparkSession,
    landed: str,
    checkpoint: str,
    rebuild: Callable[[list], None],
) -> StreamingQuery:
    """``on_changed_days`` of beacons alone, without an end to lateness."""

    def handle(batch: DataFrame, _epoch: int) -> None:
        dates = [row.date for row in batch.select("date").distinct().collect()]
        if dates:
            rebuild(sorted(dates))

    responses = (
        spark.readStream.schema(f"{S.BEACON_RESPONSE}, date DATE")
        .json(landed)
        .select(F.col("date"))
    )
    return (
        responses.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
