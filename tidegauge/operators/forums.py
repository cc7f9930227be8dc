"""Forum activity of the report date beside its own recent mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge import schemas as S
from tidegauge.functions.ranking import last_rows
from tidegauge.functions.scalars import zero

COUNTERS = [c for c in S.TABLES["forums"].fieldNames() if c not in ("date", "host")]


def forum_report(forums: DataFrame, activity: DataFrame) -> DataFrame:
    """Counters of the report date (0 if none) and the mean over the last 14 rows.

    ``activity`` is the history tagged with ``as_of``. Rows are rolling counters,
    so no day-over-day change is taken.
    """
    today = F.col("date") == F.col("as_of")
    recent = last_rows(activity, ["as_of", "host"], C.COMPARATOR_ROWS)
    report = recent.groupBy("host").agg(
        *[F.max(F.when(today, F.col(c))).alias(c) for c in COUNTERS],
        F.avg(zero(F.col("active_today"))).alias("mean_active_today"),
        F.lit(True).alias("has_data"),
    )
    return forums.join(report, "host", "left").select(
        "host",
        "name",
        *[zero(F.col(c)).alias(c) for c in COUNTERS],
        F.coalesce("mean_active_today", F.lit(0.0)).alias("mean_active_today"),
        F.coalesce("has_data", F.lit(False)).alias("has_data"),
    )


def forum_sparkline(activity: DataFrame) -> DataFrame:
    recent = last_rows(activity, ["as_of", "host"], C.SPARK_ROWS)
    return recent.select("host", "date", F.col("active_today").alias("visits"))
