"""A small estate of sites with known answers, report date 2026-08-09."""

import datetime as dt

from tidegauge import schemas as S
from tidegauge.config import Site, SiteConfig
from tidegauge.plans.report import Tables

LAST = dt.date(2026, 8, 9)
FLOODED, ZONE, SUBFLOOD, SMALL, BLOG = (
    "flooded.example", "files.example", "wiki.example", "small.example", "blog.example",
)
WALLET, FORUM, SHEETS = "wallet.example", "forum.example", "sheets.example"
IDLE = [f"idle{n}.example" for n in range(5)]
CONFIG = SiteConfig(
    tuple(Site(h) for h in [FLOODED, SUBFLOOD, SMALL, BLOG, WALLET, FORUM, SHEETS, *IDLE])
    + (Site(ZONE, measurement="zone"),),
    forums=((FORUM, "Forum"), ("quiet.example", "Quiet")),
)


def day(n):
    """August day n; zero and below fall into July."""
    return dt.date(2026, 8, 1) + dt.timedelta(n - 1)


def jround(x):
    return int(x + 0.5)


FLOODED_DAYS = [
    (day(n - 4), visits, 0.6, 1.4)
    for n, visits in enumerate([13, 10, 32, 13, 25, 11, 29, 18, 22, 16, 27, 24])
] + [(day(8), 3428, 0.99, 1.08), (day(9), 1689, 0.99, 1.08)]
ZONE_DAYS = [
    (5, 900, 17000, 58_000_000_000), (6, 910, 17500, 59_000_000_000), (7, 920, 17800, 60_000_000_000),
    (8, 940, 17400, 61_000_000_000), (9, 1059, 19506, 76_658_000_000),
]

TRAFFIC = (
    [(d, FLOODED, v, jround(v * pps), 0) for d, v, _, pps in FLOODED_DAYS]
    + [(day(n), ZONE, v, r, b) for n, v, r, b in ZONE_DAYS]
    + [(day(8), SUBFLOOD, 54, 76, 0), (day(9), SUBFLOOD, 151, 151, 0)]
    + [(day(8), SMALL, 27, 54, 0), (day(9), SMALL, 40, 82, 0)]
)


def _pair(d, host, visits, direct):
    return [
        (d, host, "(direct)", "direct", direct),
        (d, host, "www.google.com", "search", visits - direct),
    ]


REFERRERS = (
    [r for d, v, share, _ in FLOODED_DAYS for r in _pair(d, FLOODED, v, jround(v * share))]
    + _pair(day(8), SUBFLOOD, 54, 30)
    + _pair(day(9), SUBFLOOD, 151, 136)
    + _pair(day(8), SMALL, 27, 15)
    + [
        (day(9), SMALL, "(direct)", "direct", 18),
        (day(9), SMALL, "www.google.com", "search", 12),
        (day(9), SMALL, "www.small.example", "internal", 6),
        (day(9), SMALL, "chatgpt.com", "ai", 2),
    ]
)
LANDING = [
    (day(9), SUBFLOOD, "/wiki/Main_Page", 134, 134),
    (day(9), SUBFLOOD, "/sitemap.xml.gz", 10, 10),
    (day(9), SUBFLOOD, "/wiki/Other", 7, 7),
    (day(9), BLOG, "/category/a/%3E%C3%97%3C/span%3E8%3C/span%3E", 4, 4),
    (day(9), BLOG, "/category/b/page/2/%3E%C3%97%3C/span%3E4%3C/span%3E", 3, 3),
    (day(9), BLOG, "/category/c/%3E%C3%97%3C/span%3E2%3C/span%3E", 2, 2),
    (day(9), BLOG, "/2026/07/good-page/", 9, 12),
]
ZONE_PAGES = [
    (day(8), ZONE, "/robots.txt", 590, 0), (day(9), ZONE, "/robots.txt", 684, 0),
    (day(9), ZONE, "/favicon.ico", 42, 0), (day(9), ZONE, "/cdn-cgi/trace", 230, 0),
    (day(9), ZONE, "/books/some.pdf", 141, 0),
]
ZONE_STATUS = [
    (day(n), ZONE, status, requests)
    for n, status, requests in [
        (5, 200, 16800), (5, 404, 180), (6, 200, 17300), (6, 404, 200), (7, 200, 17600), (7, 404, 210),
        (8, 200, 17200), (8, 404, 190), (9, 200, 15200), (9, 404, 1745), (9, 406, 769),
    ]
]
ZONE_BOTS = [
    (day(9), ZONE, name, requests, visits)
    for name, requests, visits in [
        ("(unverified)", 16117, 843), ("Archiver", 936, 60), ("Search Engine Crawler", 867, 55),
        ("AI Crawler", 696, 40), ("Search Engine Optimization", 446, 31), ("AI Search", 405, 25),
        ("Page Preview", 39, 5),
    ]
]
KEYWORD_ROWS = [
    (WALLET, "w1", 0, 13, 31.2), (WALLET, "w2", 0, 40, 22.4), (WALLET, "w3", 1, 55, 18.7),
    (WALLET, "w4", 0, 9, 27.0), (WALLET, "w5", 0, 25, 41.5), (WALLET, "too deep", 0, 30, 62.0),
    (WALLET, "w7", 0, 90, 9.2),
    (FORUM, "not worth it", 1, 61, 12.8), (FORUM, "f2", 0, 120, 6.4), (FORUM, "f3", 1, 200, 8.1),
    (FORUM, "forum lead", 2, 150, 4.5), (FORUM, "f5", 0, 45, 11.0), (FORUM, "f6", 0, 30, 13.5),
    (SHEETS, "performs", 2, 6, 2.5), (SHEETS, "sheets lead", 0, 80, 7.7),
]


def keywords(rows=KEYWORD_ROWS):
    return [(LAST, h, q, c, i, p, "2026-08-05–2026-08-07") for h, q, c, i, p in rows]


SUMMARY = [
    (5, [(2, 400, 25.0), (8, 1400, 15.9), (3, 300, 9.9)]),
    (6, [(1, 410, 24.6), (7, 1450, 15.7), (2, 310, 9.8)]),
    (7, [(2, 415, 24.4), (5, 1470, 15.5), (3, 320, 9.6)]),
    (8, [(1, 418, 24.2), (6, 1490, 15.4), (2, 325, 9.5)]),
    (9, [(1, 420, 24.1), (6, 1500, 15.3), (2, 330, 9.4)]),
]
SUMMARIES = [
    (day(n), host, c, i, c / i, p, f"{day(n - 4)}–{day(n - 2)}")
    for n, rows in SUMMARY
    for host, (c, i, p) in zip([WALLET, FORUM, SHEETS], rows)
]
ROWS = {
    "traffic": TRAFFIC, "referrers": REFERRERS, "landing": LANDING, "zone_pages": ZONE_PAGES,
    "zone_status": ZONE_STATUS, "zone_bots": ZONE_BOTS, "keywords": keywords(),
    "search_summary": SUMMARIES,
}


def tables(spark, **changes):
    """The estate's tables; ``changes`` replaces one by other rows or by None."""
    rows = {**ROWS, **changes}
    return Tables(
        spark,
        {n: spark.createDataFrame(r, S.TABLES[n]) for n, r in rows.items() if r is not None},
    )
