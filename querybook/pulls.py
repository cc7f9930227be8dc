"""A and S: pulls that fail, and what a night writes in spite of them."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querybook.registry import query
from querybook.sql import DATE, sql
from querybook.views import CONFIG, FIRST, LAST
from tidegauge.operators import pulls
from tidegauge.plans.nightly import Landed, run_nightly
from tidegauge.sinks.scratch import new_folder
from tidegauge.sources import landed as A
from tidegauge.sources.tables import read_table

ACCOUNTS = ("a0", "a1", "a2")
TWO = replace(CONFIG, accounts=ACCOUNTS[:2])
QUOTA = '{"data":null,"errors":[{"message":"quota exceeded"}]}'
BROKEN = '{"data":{"viewer"'
# Account a0 is over its quota on every seventh day, a1 breaks off on every eleventh.
OVER = "account = 'a0' AND day(date) % 7 = 3"
CUT = "account = 'a1' AND day(date) % 11 = 5"
FAILED_DAY = "(day(date) % 7 = 3 OR day(date) % 11 = 5)"


def beacon_bodies(v, times: int, failing: bool) -> DataFrame:
    """(account, date, value): a response for each group of beacons, of two accounts.

    With ``failing`` some pulls are errors instead; counts are multiplied by ``times``.
    """
    account = F.concat(F.lit("a"), F.col("event_id") % 2)
    groups = v.beacons.groupBy(account.alias("account"), "date", "raw_host", "referer", "path").agg(
        (F.sum("views") * times).alias("views"), (F.sum("visits") * times).alias("visits")
    )
    group = F.struct(
        F.col("views").alias("count"), F.struct("visits").alias("sum"),
        F.struct(F.col("referer").alias("refererHost"), F.col("raw_host").alias("requestHost"), F.col("path").alias("requestPath")).alias("dimensions"),
    )
    listed = F.array(F.struct(F.array(group).alias("rumPageloadEventsAdaptiveGroups")))
    body = F.to_json(F.struct(F.struct(F.struct(listed.alias("accounts")).alias("viewer")).alias("data")))
    if failing:
        body = F.when(F.expr(OVER), F.lit(QUOTA)).when(F.expr(CUT), F.lit(BROKEN)).otherwise(body)
    return groups.select("account", "date", body.alias("value"))


def land_beacons(v, times: int, failing: bool) -> str:
    folder = new_folder(v.spark, "responses")
    beacon_bodies(v, times, failing).repartition("account", "date").write.partitionBy("account", "date").text(folder)
    return folder


@query("a1_pull_outcomes", sql(f"""SELECT {DATE}, 'beacons' AS source, account AS key,
  CASE WHEN account = 'a2' OR ({OVER}) OR ({CUT}) THEN 0 ELSE 1 END::BIGINT AS ok,
  CASE WHEN account = 'a2' THEN 'no response' WHEN {OVER} THEN '[{{"message":"quota exceeded"}}]'
       WHEN {CUT} THEN 'unreadable: {BROKEN}' END AS message
  FROM (SELECT DISTINCT date FROM rum), (SELECT unnest(['a0', 'a1', 'a2']) AS account)"""))
def _(v):
    """Good pulls, error bodies, broken lines, and an account that gives no response at all."""
    found = A.outcomes(v.spark, "beacons", land_beacons(v, 1, True))
    days = [FIRST + dt.timedelta(n) for n in range((LAST - FIRST).days + 1)]
    expected = pulls.expected_pulls(v.spark, replace(CONFIG, accounts=ACCOUNTS), ["beacons"], days)
    return A.settled(found, expected.join(v.rum.select("date").distinct(), "date", "left_semi"))


@query("a2_good_beacon_days", sql(f"""SELECT {DATE}, host, sum(visits)::BIGINT AS visits, sum(views)::BIGINT AS views
  FROM rum WHERE NOT {FAILED_DAY} GROUP BY date, host"""))
def _(v):
    """Sessions of the dates that all accounts have given."""
    from tidegauge.operators import ingest as B

    folder = land_beacons(v, 1, True)
    whole = pulls.good_pairs(A.outcomes(v.spark, "beacons", folder), "beacons", CONFIG.sites_df(v.spark))
    known = B.resolve_hosts(A.read_beacons(v.spark, folder), CONFIG.aliases_df(v.spark))
    return B.host_daily_traffic(known).join(whole, ["date", "host"], "left_semi").select("date", "host", "visits", "views")


@query("s7_nightly_with_failed_pulls", sql(f"""SELECT {DATE}, host, visits * CASE WHEN {FAILED_DAY} THEN 1 ELSE 2 END AS visits,
  views * CASE WHEN {FAILED_DAY} THEN 1 ELSE 2 END AS views FROM (SELECT date, host, sum(visits)::BIGINT AS visits, sum(views)::BIGINT AS views
  FROM rum WHERE NOT (host = 'site2.example' AND path = '/p/3') GROUP BY date, host)"""))
def _(v):
    """A second night has twice the counts; where a pull failed, the first night's rows stay."""
    root = new_folder(v.spark, "nights")
    for night, failing in ((1, False), (2, True)):
        landed = Landed.read(v.spark, TWO, {"beacons": land_beacons(v, night, failing)}, FIRST, LAST)
        run_nightly(v.spark, root, TWO, landed, FIRST, LAST, dt.datetime.combine(LAST, dt.time(12 + night)), history=False)
    stored = read_table(v.spark, root, "traffic").where(F.col("views") > 0)
    return stored.select("date", "host", "visits", "views")


@query("s4_run_log_of_failed_pulls", sql(f"""SELECT ok::BIGINT AS ok, note FROM (
  SELECT 0 AS ok, 'beacons a0: [{{"message":"quota exceeded"}}] | beacons a1: unreadable: {BROKEN}' AS note)
  WHERE (SELECT count(*) FROM rum) > 0"""))
def _(v):
    root = new_folder(v.spark, "notes")
    landed = Landed.read(v.spark, TWO, {"beacons": land_beacons(v, 1, True)}, FIRST, LAST)
    run_nightly(v.spark, root, TWO, landed, FIRST, LAST, dt.datetime.combine(LAST, dt.time(13)), history=False)
    return read_table(v.spark, root, "runs").select("ok", "note")
