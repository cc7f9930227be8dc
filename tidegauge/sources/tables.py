"""Stored daily tables: Parquet folders by date, read with the schema they were written with."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge import schemas as S
from tidegauge.sources.manifest import Manifest, latest

#: Stored type -> types that hold all its values.
WIDER = {
    T.ByteType(): (T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()),
    T.ShortType(): (T.IntegerType(), T.LongType(), T.DoubleType()),
    T.IntegerType(): (T.LongType(), T.DoubleType()),
    T.FloatType(): (T.DoubleType(),),
    T.DateType(): (T.TimestampType(),),
}


def widened(column: Column, stored_as: T.DataType, wanted: T.DataType, name: str) -> Column:
    """The column in its present type; an error where that could not hold every old value."""
    if stored_as == wanted:
        return column
    if wanted not in WIDER.get(stored_as, ()):
        raise ValueError(f"{name} was stored as {stored_as.simpleString()}, which {wanted.simpleString()} does not hold")
    return column.cast(wanted)


def present(df: DataFrame, stored_as: T.StructType, name: str) -> DataFrame:
    """Rows of an older schema in the present one: types widened, missing columns by default."""
    schema, defaults = S.TABLES[name], S.DEFAULTS[name]
    old = {f.name: f.dataType for f in stored_as}
    columns = []
    for f in schema:
        column = F.lit(None).cast(f.dataType)
        if f.name in old:
            column = widened(F.col(f"`{f.name}`"), old[f.name], f.dataType, f"{name}.{f.name}")
        if f.name in defaults:
            column = F.coalesce(column, F.lit(defaults[f.name]).cast(f.dataType))
        columns.append(column.alias(f.name))
    return df.select(*columns)


def _committed(spark: SparkSession, root: str, name: str, manifest: Manifest) -> DataFrame:
    """The current files of a table, one scan per schema and kind of folder."""
    groups: dict[tuple[bool, int], list[str]] = {}
    for date, entry in manifest.tables[name].items():
        folder = f"data/version={entry.version}/date={date}" if entry.version else f"date={date}"
        groups.setdefault((bool(entry.version), entry.schema), []).append(f"{root}/{name}/{folder}")
    parts = []
    for (versioned, place), paths in sorted(groups.items()):
        schema = T.StructType.fromJson(json.loads(manifest.schemas[place]))
        base = f"{root}/{name}/data" if versioned else f"{root}/{name}"
        whole = T.StructType([*schema, T.StructField("version", T.StringType())]) if versioned else schema
        parts.append(present(spark.read.schema(whole).option("basePath", base).parquet(*paths), schema, name))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], S.TABLES[name])


def stored(spark: SparkSession, root: str, name: str, manifest: Manifest | None = None) -> tuple[DataFrame, bool]:
    """A table and whether it exists; a table not yet written reads as empty.

    ``manifest`` is the state to read (the current one if it is not given). Each date is read
    with the schema it was written with and then brought to the present one.
    """
    manifest = manifest or latest(spark, root)
    if name in manifest.tables:
        return _committed(spark, root, name, manifest), True
    schema = S.TABLES[name]
    try:
        df = spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema), False
    return present(df, schema, name), True


def read_table(spark: SparkSession, root: str, name: str, manifest: Manifest | None = None) -> DataFrame:
    return stored(spark, root, name, manifest)[0]


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_at")).limit(1)


def latest_date(traffic: DataFrame) -> DataFrame:
    """One row with the last stored date; NULL when nothing is stored."""
    return traffic.agg(F.max("date").alias("date"))
