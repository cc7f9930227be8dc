"""Scalar functions, text formats and ranking against plain Python."""

import datetime as dt
import random
import statistics
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.config import Site, SiteConfig
from tidegauge.functions import ranking, scalars, text


def values(spark, column, items, ddl="x STRING"):
    return [r[0] for r in spark.createDataFrame([(i,) for i in items], ddl).select(column).collect()]


def test_malformed_urls(spark):
    bad = [
        "/category/a/%3E%C3%97%3C/span%3E8%3C/span%3E", "/category/a/>×</span>8</span>",
        "/blog//double-slash", "/wiki/span", "/broken/%zz", "/x%", "/x%4", "/a%FF", "/%C0%BC",
        "/%ED%A0%80", "/%E2%82", "/a///dup", "https://h.example//x", "/IFRAME/x",
    ]
    good = [
        "/", "/2026/07/sound/", "/books/some.pdf", "/robots.txt", "/cdn-cgi/trace", "/img/logo.png",
        "/category/uncategorized/page/2/", "/scripts/app.js", "/a/b", "/p/123",
        "/search?q=austrian%20economics", "https://h.example/2026/07/x/", "/spanish", "", None,
        "//leading", "/%C3%97", "/%E2%82%AC", "/%F0%9F%98%80", "/%EF%BF%BD",
    ]
    assert values(spark, scalars.is_malformed(F.col("x")), bad) == [True] * len(bad)
    assert values(spark, scalars.is_malformed(F.col("x")), good) == [False] * len(good)


def test_non_content_paths(spark):
    yes = ["/robots.txt", "/ROBOTS.TXT", "/favicon.ico", "/sitemap_index.xml", "/sitemap.xml.gz",
           "/.well-known/security.txt", "/.well-known", "/cdn-cgi/trace"]
    no = ["/books/some.pdf", "/books/robots.txt.pdf", "/robots.txt/x", "/sitemap/x", "/.well-knownx", "", None]
    assert values(spark, scalars.is_non_content(F.col("x")), yes) == [True] * len(yes)
    assert values(spark, scalars.is_non_content(F.col("x")), no) == [False] * len(no)


def test_referrer_kinds_and_their_quirks(spark):
    expected = {
        None: "direct", "": "direct", "(direct)": "direct", "chatgpt.com": "ai", "gemini.google.com": "ai",
        "www.Google.com": "search", "news.ycombinator.com": "social", "old.reddit.com": "social",
        # Substring matching: t.co is in microsoft.com, x.com is in netflix.com.
        "www.microsoft.com": "social", "copilot.microsoft.com": "ai", "www.netflix.com": "social",
        "example.org": "ref",
    }
    assert values(spark, scalars.referrer_kind(F.col("x")), expected) == list(expected.values())
    assert values(spark, scalars.referrer_kind(F.col("x"), F.lit(True)), ["www.google.com", ""]) == ["internal", "direct"]


def test_expected_ctr(spark):
    got = values(spark, scalars.expected_ctr(F.col("x")), [None, 0.0, 1.0, 2.0, 10.0, 100.0, 5000.0, float("inf"), float("nan"), 5.0], "x DOUBLE")
    assert got[:9] == pytest.approx([0.285, 0.285, 0.285, 0.15, 0.025, 0.001, 0.001, 0.285, 0.285])
    assert got[9] == pytest.approx(0.11 * (0.025 / 0.11) ** (2 / 7))
    assert round(got[9], 3) == 0.072


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_rounds_the_exact_binary_value(spark, digits):
    rnd = random.Random(digits)
    numbers = [rnd.randrange(100_000) / rnd.choice([7, 20, 200, 1000, 2000]) for _ in range(4000)]
    numbers += [8.85, 1.005, 0.5, 1.5, 2.5, 0.25, 0.05, 0.15, 9.95, 0.0, 1e6 + 0.05, -2.5, -0.25]
    unit = Decimal(1).scaleb(-digits)
    expected = [str(Decimal(n).quantize(unit, ROUND_HALF_UP)) for n in numbers]
    got = values(spark, F.expr(text.fixed("x", digits)), numbers, "x DOUBLE")
    assert got == expected


def test_texts(spark):
    def one(sql):
        return spark.sql(f"SELECT {sql}").first()[0]

    assert one(text.percent("0.129D", 1)) == "12.9%"
    assert one(text.number("1234567")) == "1,234,567"
    assert [one(text.byte_size(str(n))) for n in (0, 1023, 1024, 76_658_000_000, 2**41, 2**51)] == [
        "0 B", "1023 B", "1.0 KB", "71.4 GB", "2.0 TB", "2048.0 TB",
    ]
    assert one(text.sentence("it's \"{a}\" \\ {b}", a="'x'", b="'y'")) == 'it\'s "x" \\ y'
    labels = [one(text.delta_label(d, c)) for d, c in [("NULL", "5"), ("0.48D", "13"), ("-0.5D", "-13"), ("0.48D", "130"), ("-0.5D", "-1300")]]
    assert labels == ["no comparison", "+13 vs previous", "−13 vs previous", "↑ 48% vs previous", "↓ 50% vs previous"]
    assert one(text.delta_label("0D", "0", compact=True)) == "±0"


def test_display(spark):
    df = spark.sql(
        "SELECT DATE'2026-08-09' AS d, TIMESTAMP'2026-08-09 13:00:57' AS summer, TIMESTAMP'2026-01-09 05:05:00' AS winter,"
        " CAST(NULL AS DATE) AS none, 'https://a.example/x/y?z=1#q' AS url, 'https://a.example' AS root, '/p?x#y' AS path"
    )
    row = df.select(
        scalars.date_label(F.col("d")), scalars.date_label(F.col("none")), scalars.timestamp_label(F.col("summer")),
        scalars.timestamp_label(F.col("winter")), scalars.page_label(F.col("url")), scalars.page_label(F.col("root")),
        scalars.page_label(F.col("path")), scalars.search_window(F.col("d")), scalars.strip_www(F.lit("www.a.example")),
    ).first()
    assert list(row) == [
        "Aug 9, 2026", "—", "Aug 9, 7:00 AM MDT", "Jan 8, 10:05 PM MST", "/x/y?z=1", "/", "/p?x#y",
        "2026-08-05–2026-08-07", "a.example",
    ]


def test_delta_class(spark):
    rows = [(None, 100.0), (0.5, 10.0), (0.5, 30.0), (-0.5, -30.0), (0.0, 30.0)]
    df = spark.createDataFrame(rows, "d DOUBLE, c DOUBLE")
    got = [r[0] for r in df.select(scalars.delta_class(F.col("d"), F.col("c"))).collect()]
    assert got == ["none", "small", "up", "down", "neutral"]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 3), (1, None)], "a INT, b INT")
    assert [r[0] for r in df.select(scalars.ratio(F.col("a"), F.col("b"))).collect()] == [0.5, 0, 0, 0]


def skewed(spark, n=6000):
    """A third of all rows in one group."""
    rnd = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", i, rnd.randrange(1000)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g STRING, id INT, x INT").repartition(6)


@pytest.mark.parametrize("n", [3, 1200])
def test_top_n_of_a_hot_group(spark, n):
    """Below and above the size up to which Spark limits groups by itself."""
    rows, df = skewed(spark)
    got = ranking.top_n(df, ["g"], [F.desc("x"), F.asc("id")], n)
    expected = set()
    for group in {g for g, _, _ in rows}:
        best = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))[:n]
        expected |= {(*r, i + 1) for i, r in enumerate(best)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == (2 if n == 3 else 0)
    assert plan.count("Exchange hashpartitioning") == (1 if n == 3 else 2)
    assert {tuple(r) for r in got.collect()} == expected


def test_last_rows_are_stored_rows_not_days(spark):
    rows = [("a", dt.date(2026, 1, 1) + dt.timedelta(3 * i)) for i in range(20)]
    got = ranking.last_rows(spark.createDataFrame(rows, "host STRING, date DATE"), ["host"], 14)
    assert {r.date for r in got.collect()} == {d for _, d in rows[-14:]}


def test_exact_median(spark):
    rows, df = skewed(spark)
    by_group = {}
    for g, _, x in rows:
        by_group.setdefault(g, []).append(x / 7)
    got = ranking.exact_median(df.withColumn("v", F.col("x") / 7), "v", ["g"])
    assert {r.g: r.median for r in got.collect()} == pytest.approx(
        {g: statistics.median(v) for g, v in by_group.items()}
    )
    for n in (1, 2, 5, 101):
        vals = [random.Random(i).random() * 50 for i in range(n)]
        one = ranking.exact_median(spark.createDataFrame([(x,) for x in vals], "v DOUBLE"), "v")
        assert one.first().median == pytest.approx(statistics.median(vals))


def test_config(spark):
    with pytest.raises(ValueError):
        SiteConfig((Site("a", measurement="other"),))
    config = SiteConfig((Site("a", ("www.a",), deny_patterns=("(", "ok")), Site("b", measurement="zone")))
    assert config.hosts("zone") == ["b"]
    assert {tuple(r) for r in config.aliases_df(spark).collect()} == {("a", "a"), ("www.a", "a"), ("b", "b")}
    assert config.deny(spark) == {"a": ["ok"]}
    assert config.exclude_df(spark).count() == 0
    assert C.CTR_ANCHORS[0] == (1, 0.285)
