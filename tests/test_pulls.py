"""Failed pulls change no stored row; writes become visible in one step."""

import datetime as dt
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_storage import D1, D2, beacon_response, landing, rows_of, scope, write
from tidegauge import schemas as S
from tidegauge.config import FloodRules, Site, SiteConfig
from tidegauge.operators import floods, pulls, reads, signals
from tidegauge.plans.nightly import Landed, run_nightly
from tidegauge.sinks import daily, scratch
from tidegauge.sources import landed, manifest, tables
from tidegauge.streaming.landing import on_changed_days, rebuild_days

CONFIG = SiteConfig(
    (Site("a.example", search_property="sc-domain:a.example"), Site("b.example", search_property="sc-domain:b.example"),
     Site("z.example", measurement="zone")),
    forums=(("forum.example", "Forum"),), accounts=("one", "two"),
)
QUOTA = {"data": None, "errors": [{"message": "quota exceeded"}]}
REFUSED = {"error": {"code": 403, "message": "no access"}}
ZONE = ("path", "country", "status", "category")


def zone_response(**dimensions):
    names = {"path": "clientRequestPath", "country": "clientCountryName", "status": "edgeResponseStatus", "category": "verifiedBotCategory"}
    group = {"count": 10, "sum": {"visits": 4, "edgeResponseBytes": 100}, "dimensions": {names[k]: v for k, v in dimensions.items()}}
    return {"data": {"viewer": {"zones": [{"httpRequestsAdaptiveGroups": [group]}]}}}


def search_response(key, clicks):
    return {"rows": [{"keys": [key], "clicks": clicks, "impressions": 10 * clicks, "ctr": 0.1, "position": 3.0}]}


def land_all(base, day, clicks=5):
    """Good responses of every source for a day."""
    at = f"date={day.isoformat()}"
    write(base / f"beacons/account=one/{at}/1.json", beacon_response(("a.example", "", "/x", 5, clicks), ("b.example", "", "/y", 1, 1)))
    write(base / f"beacons/account=two/{at}/1.json", beacon_response(("a.example", "www.google.com", "/x", 2, 2)))
    for name, value in zip(ZONE, ("/f", "US", 200, "")):
        write(base / f"zone/host=z.example/dimension={name}/{at}/1.json", zone_response(**{name: value}))
    for host in ("a.example", "b.example"):
        write(base / f"keywords/host={host}/{at}/1.json", search_response("q", clicks))
        write(base / f"search_pages/host={host}/{at}/1.json", search_response("https://a/", clicks))
        write(base / f"search_summary/host={host}/{at}/1.json", search_response(None, clicks))
    write(base / f"forums/host=forum.example/{at}/1.json", {"about": {"stats": {"users_count": clicks}}})


SOURCES = tuple(landed.SOURCES)


def run(spark, base, root, start, end=None, hour=13, history=False):
    end = end or start
    paths = {name: f"{base}/{name}" for name in SOURCES if (base / name).exists()}
    found = Landed.read(spark, CONFIG, paths, start, end)
    return run_nightly(spark, str(root), CONFIG, found, start, end, dt.datetime.combine(end, dt.time(hour)), history=history)


def everything(spark, root, *but):
    return {n: rows_of(tables.read_table(spark, str(root), n), *S.KEYS[n]) for n in S.TABLES if n not in ("runs", "pulls", "signals", *but)}


def last_note(spark, root):
    row = tables.latest_run(tables.read_table(spark, str(root), "runs")).first()
    return row.ok, row.note


@pytest.fixture(scope="module")
def good_root(spark, tmp_path_factory):
    """Tables of a day that has been pulled whole."""
    base = tmp_path_factory.mktemp("good")
    land_all(base / "landed", D2)
    run(spark, base / "landed", base / "root", D2)
    assert last_note(spark, base / "root") == (1, "ok")
    return base / "root"


def text_of(body):
    return f"[{json.dumps(body['errors'][0])}]" if "errors" in body else json.dumps(body["error"])


# The response that fails, what it says, the note, and the tables and host that stay as they are.
CASES = [
    ("beacons/account=two", QUOTA, f"beacons two: {text_of(QUOTA)}", ("traffic", "referrers", "landing"), ("a.example", "b.example")),
    ("beacons/account=one", None, "beacons one: no response", ("traffic", "referrers", "landing"), ("a.example", "b.example")),
    ("zone/host=z.example/dimension=status", None, "zone traffic z.example: no response by status",
     ("traffic", "zone_pages", "zone_status", "zone_bots", "zone_countries"), ("z.example",)),
    ("keywords/host=a.example", REFUSED, f"gsc queries a.example: {text_of(REFUSED)}", ("keywords",), ("a.example",)),
    ("forums/host=forum.example", "<html>502 Bad Gateway</html>", "forum activity forum.example: unreadable: <html>502 Bad Gateway</html>",
     ("forums",), ("forum.example",)),
]
CHANGING = {"traffic", "referrers", "landing", "keywords", "search_pages", "search_summary", "forums"}


@pytest.mark.parametrize("folder,body,note,kept,hosts", CASES, ids=[c[0] for c in CASES])
def test_a_failed_pull_leaves_what_is_stored(spark, tmp_path, good_root, folder, body, note, kept, hosts):
    """An error body, a page in its place, or no response at all; the other sources are written."""
    base, root = tmp_path / "landed", tmp_path / "root"
    shutil.copytree(good_root, root)
    before = everything(spark, root)
    land_all(base, D2, clicks=8)
    file = base / folder / "date=2026-08-09/1.json"
    if body is None:
        file.unlink()
    else:
        file.write_text(body if isinstance(body, str) else json.dumps(body))
    result = run(spark, base, root, D2).first()
    now = everything(spark, root)
    for name in kept:
        own, old = ([r for r in rows[name] if r[1] in hosts] for rows in (now, before))
        assert own == old and own
    changed = {(n, r[1]) for n in now for r in {*now[n]} ^ {*before[n]}}
    assert not {(n, h) for n in kept for h in hosts} & changed
    assert CHANGING - set(kept) <= {n for n, _ in changed}
    assert last_note(spark, root) == (0, note[:140]) and result.notes == note[:140]
    search = folder.startswith("keywords")
    assert result.search_ok == (not search) and result.failed_hosts == ("a.example" if search else "")
    failed = tables.read_table(spark, str(root), "pulls").where("ok = 0").collect()
    assert [(r.date, r.source) for r in failed] == [(D2, folder.split("/")[0])]


def test_a_first_error_stores_nothing_for_its_source(spark, tmp_path):
    land_all(tmp_path / "landed", D2)
    (tmp_path / "landed/beacons/account=one/date=2026-08-09/1.json").write_text(json.dumps(QUOTA) + "\n" + "{broken\n")
    run(spark, tmp_path / "landed", tmp_path / "root", D2)
    now = everything(spark, tmp_path / "root")
    assert [r[1] for r in now["traffic"]] == ["z.example"] and not now["landing"] and now["keywords"]


def test_one_bad_day_of_two(spark, tmp_path):
    """Only the date of the failed pull is left as it was."""
    base, root = tmp_path / "landed", tmp_path / "root"
    for day in (D1, D2):
        land_all(base, day)
    run(spark, base, root, D1, D2)
    for day in (D1, D2):
        land_all(base, day, clicks=9)
    (base / "beacons/account=two/date=2026-08-08/1.json").write_text(json.dumps({"errors": []}))
    run(spark, base, root, D1, D2)
    visits = {(r.date, r.host): r.visits for r in tables.read_table(spark, str(root), "traffic").collect()}
    assert visits[D1, "a.example"] == 7 and visits[D2, "a.example"] == 11 and visits[D1, "z.example"] == 4


def test_outcomes_of_odd_bodies(spark, tmp_path):
    bodies = {"empty": "{}", "null": '{"rows": null, "error": null}', "none": "", "wrong": '{"rows": 7}', "text": '"busy"', "two": '{}\n{"error": {"code": 1}}'}
    for host, body in bodies.items():
        file = tmp_path / f"date=2026-08-09/host={host}/1.json"
        file.parent.mkdir(parents=True)
        file.write_text(body)
    found = {r.key: r.ok for r in landed.outcomes(spark, "keywords", str(tmp_path)).collect()}
    assert found.pop("empty") == 1 and found.pop("null") == 1 and not any(found.values())
    assert landed.read_keywords(spark, str(tmp_path)).count() == 0


def test_notes_are_bounded(spark):
    rows = [(D2, "keywords", f"h{i:03}", 0, "403") for i in range(30)] + [(D1, "beacons", "one", 0, "500"), (D2, "beacons", "one", 1, None)]
    found = pulls.notes_of(spark.createDataFrame(rows, S.TABLES["pulls"]), most=3)
    assert found == ["beacons one: 500", "gsc queries h000: 403", "gsc queries h001: 403", "and 28 more failed pulls"]


# ------------------------------------------------------------------ one commit

STEPS = ["write", "rename_new", "names"]


@pytest.mark.parametrize("step", STEPS)
def test_a_failure_between_steps_leaves_all_tables(spark, tmp_path, monkeypatch, step):
    """Whatever step of the write of two tables fails, readers see the old state of both."""
    root = str(tmp_path)
    first = landing(spark, [(D1, "a", "/x", 1, 1), (D2, "a", "/z", 3, 3)])
    traffic = spark.createDataFrame([(D1, "a", 1, 1, 0)], S.TABLES["traffic"])

    def write_both(rows, more):
        with daily.Batch(spark, root) as batch:
            batch.replace_scope("landing", rows, scope(spark, (D1, "a"), (D2, "a")))
            batch.upsert("traffic", more)

    write_both(first, traffic)
    before = everything(spark, root)
    calls = {"n": 0}
    real = getattr(manifest.Store, step)
    # The n-th call of the step fails, until there is no n-th call.
    for n in range(1, 20):
        calls["n"] = 0

        def failing(self, *args, n=n):
            calls["n"] += 1
            if calls["n"] == n:
                raise OSError("the store went away")
            return real(self, *args)

        monkeypatch.setattr(manifest.Store, step, failing)
        try:
            write_both(landing(spark, [(D1, "a", "/new", 9, 9)]), traffic.withColumn("visits", F.lit(50).cast("long")))
        except OSError:
            monkeypatch.setattr(manifest.Store, step, real)
            assert everything(spark, root) == before
        else:
            break
    assert 1 < n < 19
    monkeypatch.setattr(manifest.Store, step, real)
    now = everything(spark, root)
    assert now["landing"] == [(D1, "a", "/new", 9, 9)] and now["traffic"][0][2] == 50


def test_writers_of_other_dates_both_win_and_of_the_same_date_one(spark, tmp_path):
    root = str(tmp_path)
    one, two, three = (daily.Batch(spark, root) for _ in range(3))
    one.replace_scope("landing", landing(spark, [(D1, "a", "/1", 1, 1)]), scope(spark, (D1, "a")))
    two.replace_scope("landing", landing(spark, [(D2, "a", "/2", 2, 2)]), scope(spark, (D2, "a")))
    three.replace_scope("landing", landing(spark, [(D1, "a", "/3", 3, 3)]), scope(spark, (D1, "a")))
    one.commit()
    two.commit()
    with pytest.raises(manifest.ConcurrentWrite):
        three.commit()
    assert rows_of(tables.read_table(spark, root, "landing"), "date") == [(D1, "a", "/1", 1, 1), (D2, "a", "/2", 2, 2)]


def test_vacuum_keeps_what_is_read(spark, tmp_path):
    root = str(tmp_path)
    for n in range(6):
        daily.replace_scope(spark, root, "landing", landing(spark, [(D1, "a", f"/{n}", n, n)]), scope(spark, (D1, "a")))
    held = tables.read_table(spark, root, "landing", manifest.latest(spark, root))
    assert len(manifest.vacuum(spark, root, kept=2)) == 4 and manifest.vacuum(spark, root, kept=2) == []
    assert rows_of(held, "date") == rows_of(tables.read_table(spark, root, "landing"), "date") == [(D1, "a", "/5", 5, 5)]
    assert len(list((tmp_path / "_manifest").glob("0*.json"))) == 2


def test_partitions_of_older_types_read_as_the_present_ones(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    old = T.StructType([T.StructField("date", T.DateType()), T.StructField("host", T.StringType()), T.StructField("visits", T.IntegerType())])
    with monkeypatch.context() as before:
        before.setitem(S.TABLES, "traffic", old)
        before.setitem(S.DEFAULTS, "traffic", {"visits": 0})
        daily.upsert(spark, root, "traffic", spark.createDataFrame([(D1, "a", 7), (D1, "b", None)], old))
    daily.upsert(spark, root, "traffic", spark.createDataFrame([(D2, "a", 2**40, 1, 1)], S.TABLES["traffic"]))
    mixed = tables.read_table(spark, root, "traffic")
    assert mixed.schema.simpleString() == S.TABLES["traffic"].simpleString()
    assert rows_of(mixed, "date", "host") == [(D1, "a", 7, 0, 0), (D1, "b", 0, 0, 0), (D2, "a", 2**40, 1, 1)]
    # A rewritten table reads the same.
    daily.upsert(spark, f"{root}/new", "traffic", mixed)
    assert rows_of(tables.read_table(spark, f"{root}/new", "traffic"), "date", "host") == rows_of(mixed, "date", "host")
    # What does not fit is an error and not a wrong number.
    monkeypatch.setitem(S.TABLES, "traffic", T.StructType([f if f.name != "views" else T.StructField("views", T.IntegerType()) for f in S.TABLES["traffic"]]))
    with pytest.raises(ValueError, match="traffic.views was stored as bigint"):
        tables.read_table(spark, root, "traffic")


def test_plain_folders_are_taken_over(spark, tmp_path):
    root = str(tmp_path)
    rows = landing(spark, [(D1, "a", "/x", 1, 1), (D2, "a", "/y", 2, 2)])
    rows.write.partitionBy("date").parquet(f"{root}/landing")
    daily.replace_scope(spark, root, "landing", landing(spark, []), scope(spark, (D2, "a")))
    assert rows_of(tables.read_table(spark, root, "landing"), "date") == [(D1, "a", "/x", 1, 1)]
    assert manifest.latest(spark, root).tables["landing"]["2026-08-08"].version == ""


def test_working_folders_are_cleared(spark, tmp_path):
    with pytest.raises(ValueError), scratch.cleared(spark):
        folder = scratch.new_folder(spark, "test")
        spark.range(3).write.parquet(folder)
        raise ValueError
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


# ---------------------------------------------------------------- late responses

def test_a_late_response_of_each_source_rebuilds_its_day(spark, tmp_path):
    base, seen = tmp_path / "landed", []

    def batch():
        paths = {name: f"{base}/{name}" for name in SOURCES}
        on_changed_days(spark, paths, str(tmp_path / "checkpoint"), seen.append).awaitTermination()
        return seen.pop() if seen else {}

    for day in (D1, D2):
        land_all(base, day)
    assert batch() == {name: [D1, D2] for name in SOURCES} and batch() == {}
    for name, path, body in (
        ("beacons", "beacons/account=two", beacon_response(("a.example", "", "/late", 1, 1))),
        ("zone", "zone/host=z.example/dimension=path", zone_response(path="/late")),
        ("keywords", "keywords/host=a.example", search_response("late", 1)),
        ("forums", "forums/host=forum.example", {"about": {"stats": {"users_count": 1}}}),
    ):
        write(base / path / "date=2026-08-08/late.json", body)
        assert batch() == {name: [D1]}
    # A month behind the watermark nothing is open any more; a new day is, and alone.
    write(base / "beacons/account=two/date=2026-07-01/late.json", beacon_response(("a.example", "", "/x", 1, 1)))
    write(base / "beacons/account=two/date=2026-08-10/1.json", beacon_response(("a.example", "", "/x", 1, 1)))
    assert batch() == {"beacons": [D2 + dt.timedelta(1)]}


def test_a_late_day_is_built_again_from_all_its_responses(spark, tmp_path):
    base, root = tmp_path / "landed/beacons", str(tmp_path / "root")
    config = SiteConfig((Site("a.example"),), accounts=("one",))
    rebuild = rebuild_days(spark, root, config, {"beacons": str(base)}, lambda: dt.datetime(2026, 8, 11, 13))
    at = base / "account=one"
    for day, visits in ((D1, 3), (D2, 4)):
        write(at / f"date={day}/1.json", beacon_response(("a.example", "", "/x", 5, visits)))
    rebuild({"beacons": [D1, D2]})
    write(at / f"date={D1}/2.json", beacon_response(("a.example", "", "/y", 1, 1)))
    rebuild({"beacons": [D1]})
    assert [(r.date, r.visits) for r in tables.read_table(spark, root, "traffic").orderBy("date").collect()] == [(D1, 4), (D2, 4)]


# -------------------------------------------------------- many dates, and history

def test_many_report_dates_classify_like_single_ones(spark):
    draw = random.Random(6)
    days = [D2 - dt.timedelta(n) for n in range(50) if n % 7 != 3]
    rows = [(d, h, draw.choice([0, 5, 20, 300]), draw.choice([5, 25, 310]), 0) for d in days for h in ("a.example", "b.example")]
    traffic = spark.createDataFrame([*rows, (D2, "b.example", None, None, None)][: len(rows)], S.TABLES["traffic"])
    kinds = spark.createDataFrame([(d, h, "direct", int(v * draw.choice([0, 0.5, 1]))) for d, h, v, _, _ in rows], "date date, host string, kind string, visits long")
    rules = FloodRules(min_visits=10, multiple=1.5, direct_share=0.6)
    dates = [D2 + dt.timedelta(3 - n) for n in range(0, 70, 2)]
    hosts = CONFIG.sites_df(spark)
    many = floods.classify_many(traffic, kinds, hosts, dates, 30, rules)
    columns = ["as_of", "host", "date", "visits", "direct", "signature", "baseline", "flood"]
    expected = []
    for date in dates:
        period = reads.Period(date)
        one = floods.classify_floods(reads.within(traffic, period), reads.within(kinds, period), rules)
        expected.append(one.select(*columns))
    whole = expected[0]
    for part in expected[1:]:
        whole = whole.union(part)
    got = sorted(map(tuple, many.select(*columns).collect()))
    assert got == sorted(map(tuple, whole.collect())) and any(r[-1] for r in got)
    # The days of a site meet once, before they are given to report dates.
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode(history") < plan.index("Window")


def test_signals_of_a_night_continue_the_stored_ones(spark, tmp_path):
    root, names = str(tmp_path), S.TABLES["signals"].fieldNames()

    def found(*days):
        return spark.createDataFrame(
            [(d, "a", k, 3, 1.0, "h", "e", "x") for d, k in days], "as_of date, host string, kind string, severity int, weight double, headline string, evidence string, action string")

    nights = [[(D1, "p"), (D1, "q")], [(D2, "p")], [(D2 + dt.timedelta(1), "p"), (D2 + dt.timedelta(1), "q")]]
    for night in nights:
        before = tables.read_table(spark, root, "signals").where(F.col("date") == F.lit(night[0][0] - dt.timedelta(1)))
        rows = signals.recurrence(found(*night), 2, before).withColumn("date", F.col("as_of")).select(*names)
        daily.replace_scope(spark, root, "signals", rows, scope(spark, (night[0][0], "a")))
    stored = {(r.date, r.kind, r.recurrence, r.severity) for r in tables.read_table(spark, root, "signals").collect()}
    whole = signals.recurrence(found(*[x for night in nights for x in night]), 2)
    assert stored == {(r.as_of, r.kind, r.recurrence, r.severity) for r in whole.collect()}
    assert (D2 + dt.timedelta(1), "p", 2, 2) in stored and (D2 + dt.timedelta(1), "q", 0, 3) in stored


def test_a_night_stores_its_signals(spark, tmp_path, good_root):
    shutil.copytree(good_root, tmp_path / "root")
    land_all(tmp_path / "landed", D2 + dt.timedelta(1))
    run(spark, tmp_path / "landed", tmp_path / "root", D2 + dt.timedelta(1), history=True)
    assert tables.stored(spark, str(tmp_path / "root"), "signals")[1]
