"""The list of queries: name -> callable, and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querybook.views import Views
from tidegauge.functions.ranking import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def out(df: DataFrame) -> DataFrame:
    """Dates as text, doubles rounded to six places, integers as 64 bit."""
    columns = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DoubleType):
            col = F.round(col, 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            col = col.cast("long")
        columns.append(col.alias(f.name))
    return df.select(*columns)


def placed(df: DataFrame) -> DataFrame:
    """The rows with their place in the order that they come in, so that it is compared too."""
    return numbered(df, "place")


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``, with its SQL twin."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: out(fn(Views(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
