"""Audit of configured search properties against the ones that can be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def property_audit(configured: DataFrame, granted: DataFrame) -> DataFrame:
    """One row per configured property and per granted property that no site uses.

    status: ``ok`` with its level, ``missing`` (``swapped`` names the same
    property on the other protocol if that one is granted) or ``unused``.
    """
    property_ = F.col("property")
    wanted = configured.where(property_.isNotNull()).select("host", "property")
    swapped = (
        F.when(
            property_.startswith("https://"),
            F.regexp_replace(property_, "^https:", "http:"),
        ).when(
            property_.startswith("http://"),
            F.regexp_replace(property_, "^http:", "https:"),
        )
    )
    reachable = granted.select("property", "level")
    other = granted.select(F.col("property").alias("swapped"), F.lit(True).alias("swap_granted"))
    status = (
        F.when(F.col("host").isNull(), "unused")
        .when(F.col("level").isNotNull(), "ok")
        .otherwise("missing")
    )
    return (
        wanted.join(reachable, "property", "full_outer")
        .withColumn("status", status)
        .withColumn("swapped", F.when(F.col("status") == "missing", swapped))
        .join(other, "swapped", "left")
        .withColumn("swapped", F.when(F.col("swap_granted"), F.col("swapped")))
        .select("host", "property", "status", "level", "swapped")
    )
