"""Sources, sinks, the nightly plan and incremental landing."""

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidegauge import schemas as S
from tidegauge.config import Site, SiteConfig
from tidegauge.operators import audit, reads
from tidegauge.operators.digest import clip_note, search_ok
from tidegauge.plans.nightly import Landed, run_nightly
from tidegauge.plans.report import Report, Tables
from tidegauge.sinks import daily
from tidegauge.sources import landed, tables
from tidegauge.streaming.landing import on_new_dates

D1, D2 = dt.date(2026, 8, 8), dt.date(2026, 8, 9)


def write(path, document):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(document) + "\n")


def beacon_response(*groups):
    rows = [
        {"count": c, "sum": {"visits": v}, "dimensions": {"refererHost": r, "requestHost": h, "requestPath": p}}
        for h, r, p, c, v in groups
    ]
    return {"data": {"viewer": {"accounts": [{"rumPageloadEventsAdaptiveGroups": rows}]}}}


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_search_responses(spark, tmp_path):
    full = {"rows": [{"keys": ["b"], "clicks": 3, "impressions": 9, "ctr": 0.33, "position": 4.5}, {"keys": ["a"]}]}
    write(tmp_path / "date=2026-08-09/host=x.example/1.json", full)
    write(tmp_path / "date=2026-08-09/host=empty.example/1.json", {})
    path = str(tmp_path)
    keywords = rows_of(landed.read_keywords(spark, path).select("host", "query", "clicks", "position", "search_window"), "query")
    assert keywords == [
        ("x.example", "a", 0, 0.0, "2026-08-05–2026-08-07"),
        ("x.example", "b", 3, 4.5, "2026-08-05–2026-08-07"),
    ]
    assert landed.read_keywords(spark, path, limit=1).first()["query"] == "b"
    summary = rows_of(landed.read_search_summary(spark, path).select("host", "clicks", "ctr"), "host")
    assert summary == [("empty.example", 0, 0.0), ("x.example", 3, 0.33)]


def test_forum_responses(spark, tmp_path):
    stats = {"users_count": 10, "active_users_last_day": 3, "posts_count": 7}
    write(tmp_path / "date=2026-08-09/host=a.example/1.json", {"about": {"stats": stats}})
    write(tmp_path / "date=2026-08-09/host=b.example/1.json", {"about": {"stats": {}}})
    write(tmp_path / "date=2026-08-09/host=c.example/1.json", {"about": {}})
    got = rows_of(landed.read_forums(spark, str(tmp_path)).select("host", "users_count", "active_today", "posts_count", "new_7d"), "host")
    assert got == [("a.example", 10, 3, 7, 0), ("b.example", 0, 0, 0, 0), ("c.example", 0, 0, 0, 0)]


def test_missing_table_reads_as_empty(spark, tmp_path):
    df, measured = tables.stored(spark, str(tmp_path), "zone_bots")
    assert not measured and df.count() == 0 and df.schema == S.TABLES["zone_bots"]
    (tmp_path / "traffic").mkdir()
    (tmp_path / "traffic" / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception) as broken:
        tables.read_table(spark, str(tmp_path), "traffic").count()
    assert not isinstance(broken.value, AnalysisException)
    assert tables.latest_date(df).first().date is None


def landing(spark, rows):
    return spark.createDataFrame(rows, S.TABLES["landing"])


def scope(spark, *pairs):
    return spark.createDataFrame(list(pairs), "date DATE, host STRING")


def test_replace_scope(spark, tmp_path):
    root = str(tmp_path)
    first = landing(spark, [(D1, "a", "/x", 1, 1), (D1, "b", "/y", 2, 2), (D2, "a", "/z", 3, 3)])
    whole = scope(spark, (D1, "a"), (D1, "b"), (D2, "a"))
    for _ in range(2):  # a second run changes nothing
        daily.replace_scope(spark, root, "landing", first, whole)
        got = rows_of(tables.read_table(spark, root, "landing"), "date", "host")
        assert got == rows_of(first, "date", "host")
    # a has nothing any more on either day: the shared day keeps b, the other one is emptied.
    daily.replace_scope(spark, root, "landing", landing(spark, []), scope(spark, (D1, "a"), (D2, "a")))
    assert rows_of(tables.read_table(spark, root, "landing"), "date") == [(D1, "b", "/y", 2, 2)]
    # Rows outside the scope are not written, and an empty scope does nothing.
    daily.replace_scope(spark, root, "landing", landing(spark, [(D1, "c", "/q", 9, 9)]), scope(spark, (D1, "a")))
    daily.replace_scope(spark, root, "landing", first, whole.where(F.lit(False)))
    assert rows_of(tables.read_table(spark, root, "landing"), "date") == [(D1, "b", "/y", 2, 2)]


def test_failed_rebuild_leaves_the_table(spark, tmp_path):
    root = str(tmp_path)
    rows = landing(spark, [(D1, "a", "/x", 1, 1)])
    daily.replace_scope(spark, root, "landing", rows, scope(spark, (D1, "a")))
    broken = rows.withColumn("views", F.raise_error(F.lit("source broke")).cast("long"))
    with pytest.raises(Exception):
        daily.replace_scope(spark, root, "landing", broken, scope(spark, (D1, "a")))
    assert rows_of(tables.read_table(spark, root, "landing"), "date") == [(D1, "a", "/x", 1, 1)]


def test_search_scope(spark):
    config = SiteConfig((Site("a", search_property="p"), Site("b", search_property="q"), Site("c")))
    sites = config.sites_df(spark)
    assert daily.search_scope(sites, D1, False).count() == 0
    assert rows_of(daily.search_scope(sites, D1, True), "host") == [(D1, "a"), (D1, "b")]
    assert rows_of(daily.search_scope(sites, D1, True, ["a"]), "host") == [(D1, "b")]


def test_run_notes():
    assert search_ok(["zone traffic a: 500"]) and not search_ok(["gsc pages a: 403"])
    assert len(clip_note("gsc auth: " + "x" * 300)) == 160 and len(clip_note("gsc pages " + "x" * 300)) == 140


CONFIG = SiteConfig((
    Site("a.example", ("www.a.example",), "sc-domain:a.example", exclude_paths=("/skip",)),
    Site("idle.example"),
    Site("z.example", measurement="zone"),
))


def land(tmp_path, day, *groups, name="1"):
    write(tmp_path / f"landed/date={day.isoformat()}/{name}.json", beacon_response(*groups))


def nightly(spark, tmp_path, day, zone_rows, **extra):
    zone = spark.createDataFrame(
        zone_rows, "date DATE, host STRING, path STRING, country STRING, status INT, category STRING,"
        " requests BIGINT, visits BIGINT, bytes BIGINT",
    )
    beacons = landed.read_beacons(spark, str(tmp_path / "landed")).where(F.col("date") == F.lit(day))
    at = dt.datetime.combine(day, dt.time(13))
    run_nightly(spark, str(tmp_path / "root"), CONFIG, Landed(beacons, zone, **extra), day, day, at)


def test_nightly_run(spark, tmp_path):
    land(
        tmp_path, D2,
        ("a.example", "", "/x", 5, 3), ("www.a.example", "www.google.com", "", 2, 2),
        ("a.example", "www.a.example", "/x", 1, 1), ("a.example", "", "/skip", 100, 100),
        ("unknown.example", "", "/x", 50, 50), ("a.example", "b.example", "/y", 4, 0),
    )
    zone = [(D2, "z.example", "/f", "", 404, "", 7, 1, 70), (D2, "z.example", "", "US", 200, "Archiver", 3, 2, 30)]
    for _ in range(2):
        nightly(spark, tmp_path, D2, zone)
    read = lambda name: rows_of(tables.read_table(spark, str(tmp_path / "root"), name).drop("date"), *S.KEYS[name][1:])
    assert read("traffic") == [("a.example", 6, 12, 0), ("idle.example", 0, 0, 0), ("z.example", 3, 10, 100)]
    assert read("referrers") == [
        ("a.example", "(direct)", "direct", 3), ("a.example", "www.a.example", "internal", 1),
        ("a.example", "www.google.com", "search", 2),
    ]
    assert read("landing") == [("a.example", "/", 2, 2), ("a.example", "/x", 4, 6), ("a.example", "/y", 0, 4)]
    assert read("zone_pages") == [("z.example", "/", 3, 2), ("z.example", "/f", 7, 1)]
    assert read("zone_countries") == [("z.example", "US", 2), ("z.example", "Unknown", 1)]
    assert read("zone_status") == [("z.example", 200, 3), ("z.example", 404, 7)]
    assert read("zone_bots") == [("z.example", "(unverified)", 7, 1), ("z.example", "Archiver", 3, 2)]
    runs = tables.read_table(spark, str(tmp_path / "root"), "runs").collect()
    assert [(r.ok, r.note) for r in runs] == [(1, "ok")]
    # The report reads what the run has written.
    report = Report(Tables.stored(spark, str(tmp_path / "root")), CONFIG, reads.Period(D2), pin=True)
    assert report.totals.first().visits == 6


def test_report_reads_prune_partitions(spark, tmp_path):
    rows = spark.createDataFrame(
        [(D2 - dt.timedelta(n), "a", 1, 1, 0) for n in range(50)], S.TABLES["traffic"]
    )
    daily.upsert(spark, str(tmp_path), "traffic", rows)
    read = reads.within(tables.read_table(spark, str(tmp_path), "traffic"), reads.Period(D2, 7))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert read.count() == 30


def test_incremental_landing_rebuilds_touched_days(spark, tmp_path):
    seen = []
    source, checkpoint = str(tmp_path / "landed"), str(tmp_path / "checkpoint")

    def run():
        on_new_dates(spark, source, checkpoint, seen.append).awaitTermination()

    land(tmp_path, D1, ("a.example", "", "/x", 1, 1))
    land(tmp_path, D2, ("a.example", "", "/x", 1, 1))
    run()
    run()  # nothing new
    land(tmp_path, D1, ("a.example", "", "/late", 1, 1), name="2")
    run()
    assert seen == [[D1, D2], [D1]]


def test_property_audit(spark):
    configured = spark.createDataFrame(
        [("a", "sc-domain:a"), ("b", "https://b/"), ("c", "http://c/"), ("d", None), ("e", "https://e/")],
        "host STRING, property STRING",
    )
    granted = spark.createDataFrame(
        [("sc-domain:a", "owner"), ("http://b/", "full"), ("https://c/", "full"), ("sc-domain:x", "full")],
        "property STRING, level STRING",
    )
    got = {(r.host, r.property): (r.status, r.level, r.swapped) for r in audit.property_audit(configured, granted).collect()}
    assert got == {
        ("a", "sc-domain:a"): ("ok", "owner", None),
        ("b", "https://b/"): ("missing", None, "http://b/"),
        ("c", "http://c/"): ("missing", None, "https://c/"),
        ("e", "https://e/"): ("missing", None, None),
        (None, "http://b/"): ("unused", "full", None),
        (None, "https://c/"): ("unused", "full", None),
        (None, "sc-domain:x"): ("unused", "full", None),
    }


def test_parameters_fall_back(spark):
    params = reads.report_params(CONFIG, 9, "no.example", "size")
    assert (params.period_days, params.domain, params.sort) == (1, None, "traffic")
    assert reads.report_params(CONFIG, 30, "a.example", "name").domain == "a.example"
    period = reads.Period(D2, 30)
    assert period.history_start == D2 - dt.timedelta(59)
    assert reads.Period(D2, 7).history_start == D2 - dt.timedelta(29)


def test_page_filter_and_cap(spark):
    pages = spark.createDataFrame(
        [("a", "https://a/1"), ("a", "https://b/1"), ("c", "https://c/1")], "host STRING, page STRING"
    )
    assert landed.filter_pages(pages, {}) is pages
    assert rows_of(landed.filter_pages(pages, {"a": "^https://a/"}), "page") == [("a", "https://a/1"), ("c", "https://c/1")]
    assert landed.cap_groups(pages.withColumn("n", F.length("page")), ["host"], "n", ["page"], 1).count() == 2


def stored(spark, tmp_path, name, *order):
    return rows_of(tables.read_table(spark, str(tmp_path / "root"), name).drop("date"), *(order or S.KEYS[name][1:]))


def run_at(day):
    return dt.datetime.combine(day, dt.time(13))


ZONE_COLUMNS = "date DATE, host STRING, path STRING, country STRING, status INT, category STRING, requests BIGINT, visits BIGINT, bytes BIGINT"


def test_landed_groups_are_counted_once(spark, tmp_path):
    """A response per dimension, each with all requests: totals are those of one of them."""
    def group(n, visits, size, **dimensions):
        return {"count": n, "sum": {"visits": visits, "edgeResponseBytes": size}, "dimensions": dimensions}

    responses = {
        "total": [group(10, 3, 100)],
        "path": [group(7, 1, 70, clientRequestPath="/f"), group(2, 1, 20, clientRequestPath=""), group(1, 1, 10)],
        "country": [group(10, 3, 100, clientCountryName="US")],
        "status": [group(7, 1, 70, edgeResponseStatus=404), group(3, 2, 30, edgeResponseStatus=200)],
        "category": [group(3, 2, 30, verifiedBotCategory="Archiver"), group(7, 1, 70, verifiedBotCategory="")],
    }
    for dimension, groups in responses.items():
        folder = tmp_path / f"zone/date={D2.isoformat()}/host=z.example/dimension={dimension}"
        write(folder / "1.json", {"data": {"viewer": {"zones": [{"httpRequestsAdaptiveGroups": groups}]}}})
    groups = landed.read_zone(spark, str(tmp_path / "zone"))
    run_nightly(spark, str(tmp_path / "root"), CONFIG, Landed(zone_groups=groups), D2, D2, run_at(D2))
    assert stored(spark, tmp_path, "traffic") == [("z.example", 3, 10, 100)]
    assert stored(spark, tmp_path, "zone_pages") == [("z.example", "/", 3, 2), ("z.example", "/f", 7, 1)]
    assert stored(spark, tmp_path, "zone_countries") == [("z.example", "US", 3)]
    assert stored(spark, tmp_path, "zone_status") == [("z.example", 200, 3), ("z.example", 404, 7)]
    assert stored(spark, tmp_path, "zone_bots") == [("z.example", "(unverified)", 7, 1), ("z.example", "Archiver", 3, 2)]
    with pytest.raises(ValueError):
        run_nightly(spark, str(tmp_path / "root"), CONFIG, Landed(zone_log=groups, zone_groups=groups), D2, D2, run_at(D2))


def test_sources_that_were_not_pulled_stay(spark, tmp_path):
    land(tmp_path, D2, ("a.example", "", "/x", 5, 3))
    nightly(spark, tmp_path, D2, [(D2, "z.example", "/f", "", 404, "", 7, 1, 70)])
    beacons = landed.read_beacons(spark, str(tmp_path / "landed"))
    run_nightly(spark, str(tmp_path / "root"), CONFIG, Landed(beacons), D2, D2, run_at(D2))
    assert stored(spark, tmp_path, "traffic") == [("a.example", 3, 5, 0), ("idle.example", 0, 0, 0), ("z.example", 1, 7, 70)]
    assert stored(spark, tmp_path, "zone_pages") == [("z.example", "/f", 7, 1)]


def test_nothing_is_cut_when_stored(spark, tmp_path):
    """60 referrers above (direct), 12 statuses: the flood and the error share see all of them."""
    names = [f"r{i}.example" for i in range(60)]
    land(tmp_path, D2, *[("a.example", r, "/x", 4, 4) for r in names], ("a.example", "", "/x", 3, 3))
    zone = [(D2, "z.example", f"/p{i}", f"C{i % 30}", 400 + i, "", 10 - i % 3, 1, 1) for i in range(70)]
    nightly(spark, tmp_path, D2, zone)
    referrers = stored(spark, tmp_path, "referrers")
    assert len(referrers) == 61 and ("a.example", "(direct)", "direct", 3) in referrers
    assert len(stored(spark, tmp_path, "zone_status")) == 70 and len(stored(spark, tmp_path, "zone_pages")) == 70
    assert len(stored(spark, tmp_path, "zone_countries")) == 30
    report = Report(Tables.stored(spark, str(tmp_path / "root")), CONFIG, reads.Period(D2))
    shape = report.split.where("host = 'a.example'").first()
    assert (shape.direct, shape.non_direct) == (3, 240)


def test_landed_reads_prune_dates(spark, tmp_path):
    land(tmp_path, D1, ("a.example", "", "/x", 1, 1))
    land(tmp_path, D2, ("a.example", "", "/x", 1, 1))
    from tidegauge.plans.nightly import daily_tables

    landed_rows = Landed(landed.read_beacons(spark, str(tmp_path / "landed")))
    rows = daily_tables(spark, CONFIG, landed_rows, D2, D2)["traffic"]
    assert rows_of(rows.where("visits > 0"), "host") == [(D2, "a.example", 1, 1, 0)]
    read = landed.read_beacons(spark, str(tmp_path / "landed")).where(F.col("date").between(F.lit(D2), F.lit(D2)))
    assert "PartitionFilters: [isnotnull(date" in read._jdf.queryExecution().executedPlan().toString()


def test_search_totals_leave_other_hosts_out(spark, tmp_path):
    """Hosts that are no longer configured stay in the tables but not in the report."""
    keyword = lambda host: (D2, host, "q", 5, 100, 0.05, 2.0, "w")
    frames = {
        name: spark.createDataFrame([dict(zip(["date", "host", key, "clicks", "impressions", "ctr", "position", "search_window"], keyword(h))) for h in ("a.example", "gone.example")], S.TABLES[name])
        for name, key in (("keywords", "query"), ("search_pages", "page"))
    }
    summary = [(D2, h, 5, 100, 0.05, 2.0, "w") for h in ("a.example", "gone.example")]
    names = ["date", "host", "clicks", "impressions", "ctr", "position", "search_window"]
    frames["search_summary"] = spark.createDataFrame([dict(zip(names, r)) for r in summary], S.TABLES["search_summary"])
    report = Report(Tables(spark, frames), CONFIG, reads.Period(D2))
    for rows in (report.keywords, report.search_pages, report.search_latest, report.search_history):
        assert [r.host for r in rows.collect()] == ["a.example"]


def test_deny_and_page_patterns_are_literals(spark):
    from tidegauge.operators import opportunities

    rows = spark.createDataFrame([("a", "free stuff"), ("a", "other"), ("b", "free"), ("c", None)], "host STRING, query STRING")
    marked = opportunities.mark_denied(rows, {"a": ["^FREE", "x"], "b": ["x"]})
    assert rows_of(marked, "host", "query") == [("a", "free stuff", True), ("a", "other", False), ("b", "free", False), ("c", None, False)]
    assert "Join" not in marked._jdf.queryExecution().executedPlan().toString()
    assert not opportunities.mark_denied(rows, {}).where("denied").count()
