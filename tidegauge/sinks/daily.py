"""Keyed upsert and scoped replace of daily tables, made visible in one step.

A batch fills new version folders for the dates it touches and then commits one
manifest for all its tables (``sources.manifest``). Whatever fails before that leaves every
table as it was. Rows are written once, and no date is overwritten in place.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge import schemas as S
from tidegauge.operators.digest import clip_note
from tidegauge.sinks.scratch import staged
from tidegauge.sources.manifest import Entry, Manifest, Store, commit, latest, plain_dates
from tidegauge.sources.tables import read_table


class Batch:
    """Writes to the tables below ``root`` that become visible together.

    Used as a context manager it commits at the end, unless there was an exception. A
    table may be written more than once: later writes see the earlier ones.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.base = self.now = latest(spark, self.root)
        self.changes: dict[str, dict[str, Entry | None]] = {}

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind, _error, _trace) -> None:
        if kind is None:
            self.commit()

    def commit(self) -> Manifest:
        if self.changes:
            self.base = commit(self.spark, self.root, self.base, self.changes, self.now.schemas)
            self.now, self.changes = self.base, {}
        return self.base

    def read(self, name: str) -> DataFrame:
        """The table as this batch has made it so far."""
        return read_table(self.spark, self.root, name, self.now)

    def _adopt(self, name: str) -> None:
        """Take dates of plain folders into the manifest, as they were before it."""
        if name not in self.now.tables:
            schema = self._place(name)
            self._change(name, {d: Entry("", schema) for d in plain_dates(self.spark, self.root, name)})

    def _place(self, name: str) -> int:
        text = S.TABLES[name].json()
        if text not in self.now.schemas:
            self.now = Manifest(self.now.number, (*self.now.schemas, text), self.now.tables)
        return self.now.schemas.index(text)

    def _change(self, name: str, dates: dict[str, Entry | None]) -> None:
        self.changes.setdefault(name, {}).update(dates)
        number = self.now.number
        moved = self.now.with_changes({name: dates}, self.now.schemas)
        self.now = Manifest(number, moved.schemas, moved.tables)

    def _rebuild(self, name: str, rows: DataFrame, dates: Sequence[dt.date]) -> None:
        """Put ``rows`` in place of everything that the table holds for ``dates``."""
        version = uuid.uuid4().hex
        schema = self._place(name)
        # REBALANCE lets AQE split a busy date and merge quiet ones into good file sizes.
        ready = rows.select(*S.TABLES[name].fieldNames()).hint("rebalance", "date")
        ready.write.partitionBy("date").parquet(f"{self.root}/{name}/data/version={version}")
        folders = Store(self.spark, self.root).names(name, "data", f"version={version}")
        filled = {n.removeprefix("date=") for n in folders if n.startswith("date=")}
        touched = {d.isoformat() for d in dates} | filled
        self._change(name, {d: Entry(version, schema) if d in filled else None for d in touched})

    def replace_scope(self, name: str, rows: DataFrame, scope: DataFrame) -> None:
        """Replace everything stored for the (date, host) pairs of ``scope`` by ``rows``.

        The scope is a table of its own because a host that now has no rows must be
        cleared as well. Pairs outside the scope are untouched; rows outside it are
        not written. Running it twice gives the same table.
        """
        keys = ["date", "host"]
        pairs = scope.select(*keys).distinct()
        dates = _touched_dates(pairs)
        if not dates:
            return
        self._adopt(name)
        kept = self.read(name).where(F.col("date").isin(dates)).join(pairs, keys, "left_anti")
        self._rebuild(name, kept.unionByName(rows.join(pairs, keys, "left_semi").select(*kept.columns)), dates)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Insert rows, or put them in place of the stored rows with the same key.

        Of incoming rows with one key the largest, column by column, is stored; rows
        without a date are not.
        """
        keys = list(S.KEYS[name])
        fields = S.TABLES[name].fieldNames()
        rest = [c for c in fields if c not in keys]
        one = rows.where(F.col("date").isNotNull()).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("one")).select(*keys, "one.*")
        rows = staged(one.select(*fields), f"new-{name}")
        dates = _touched_dates(rows)
        if not dates:
            return
        self._adopt(name)
        kept = self.read(name).where(F.col("date").isin(dates)).join(rows.select(*keys), keys, "left_anti")
        self._rebuild(name, kept.unionByName(rows), dates)

    def log_run(self, run_at: dt.datetime, date: dt.date, notes: Sequence[str] = ()) -> None:
        """Record a run; one with the same time replaces the earlier record."""
        self.upsert("runs", run_row(self.spark, run_at, date, notes))


def _touched_dates(scope: DataFrame) -> list[dt.date]:
    """Dates to rebuild: calendar days, so their number is bounded by the history."""
    return [row.date for row in scope.select("date").distinct().collect() if row.date is not None]


def replace_scope(spark: SparkSession, root: str, name: str, rows: DataFrame, scope: DataFrame) -> None:
    """``Batch.replace_scope`` of one table, committed."""
    with Batch(spark, root) as batch:
        batch.replace_scope(name, rows, scope)


def upsert(spark: SparkSession, root: str, name: str, rows: DataFrame) -> None:
    """``Batch.upsert`` of one table, committed."""
    with Batch(spark, root) as batch:
        batch.upsert(name, rows)


def log_run(
    spark: SparkSession, root: str, run_at: dt.datetime, date: dt.date, notes: Sequence[str] = ()
) -> None:
    """``Batch.log_run``, committed."""
    with Batch(spark, root) as batch:
        batch.log_run(run_at, date, notes)


def refresh_scope(
    sites: DataFrame, days: Sequence[dt.date], available: bool = True,
    failed_hosts: Sequence[str] = (), good: DataFrame | None = None,
) -> DataFrame:
    """Which (date, host) pairs of a table a run may replace: one rule for all tables.

    ``sites`` are those that the table's source measures. Nothing at all when the source was not
    available, nor the hosts whose pull failed; where it is known which pulls were ``good``
    (date, host), only those. All other stored rows stay.
    """
    scope = sites.select(F.explode(F.array(*[F.lit(d) for d in days])).alias("date"), "host")
    if not available or not days:
        return scope.where(F.lit(False))
    if failed_hosts:
        scope = scope.where(~F.col("host").isin(list(failed_hosts)))
    return scope if good is None else scope.join(good, ["date", "host"], "left_semi")


def search_scope(
    sites: DataFrame, date: dt.date, available: bool, failed_hosts: Sequence[str] = ()
) -> DataFrame:
    """``refresh_scope`` of a search table on one day: the sites that have a property."""
    return refresh_scope(sites.where(F.col("property").isNotNull()), [date], available, failed_hosts)


def run_row(
    spark: SparkSession, run_at: dt.datetime, date: dt.date, notes: Sequence[str] = ()
) -> DataFrame:
    note = C.NOTE_SEPARATOR.join(clip_note(n) for n in notes) or C.RUN_OK_NOTE
    return spark.createDataFrame([(run_at, date, int(not notes), note)], S.TABLES["runs"])


def write_report_json(report: DataFrame, path: str) -> None:
    """The nested report, one JSON document per site."""
    report.write.mode("overwrite").json(path)
