"""Values that have to be exactly these for results to agree.

Everything here is data, not logic: thresholds, word lists, patterns, the
click-through curve and the wording of report text.
"""

# ---------------------------------------------------------------- fixed values
# Crawler-flood thresholds.
FLOOD_MIN_VISITS = 500
FLOOD_MULTIPLE = 3.0
FLAT_PAGES_PER_SESSION = 1.15
DIRECT_SHARE = 0.9

# ---------------------------------------------------------------- fixed values
# Referrer channels. A lower-cased referrer belongs to the first list of which it
# contains an entry; the lists are tried in the order ai, search, social.
AI_ANSWER_ENGINES = (
    "chatgpt.com", "chat.openai.com", "claude.ai", "perplexity.ai",
    "gemini.google.com", "copilot.microsoft.com", "you.com", "poe.com",
)
SEARCH_ENGINES = (
    "google.", "bing.", "duckduckgo.", "search.brave.", "yandex.", "ecosia.",
    "search.marginalia", "yahoo.",
)
SOCIAL_NETWORKS = (
    "reddit.", "reddit.frontpage", "linkedin.", "facebook.", "x.com", "t.co",
    "twitter.", "instagram.", "youtube.", "news.ycombinator", "mastodon", "bsky",
    "t.me", "telegram",
)

# ---------------------------------------------------------------- fixed values
# Names given to empty dimension values.
DIRECT_REFERRER = "(direct)"
ROOT_PATH = "/"
UNKNOWN_COUNTRY = "Unknown"
UNVERIFIED_CATEGORY = "(unverified)"

# ---------------------------------------------------------------- fixed values
# How many rows of each ranked list are stored and how many a site card shows.
SOURCE_GROUP_CAP = 5000
STORED_REFERRERS = 50
STORED_LANDING_PAGES = 50
STORED_ZONE_PATHS = 50
STORED_ZONE_COUNTRIES = 10
STORED_ZONE_STATUSES = 8
STORED_KEYWORDS = 500
STORED_SEARCH_PAGES = 15
CARD_REFERRERS = 8
CARD_KEYWORDS = 12
CARD_SEARCH_PAGES = 8
CARD_LANDING_PAGES = 8
CARD_COUNTRIES = 10
CARD_STATUSES = 8
SPARK_ROWS = 14
COMPARATOR_ROWS = 14
HISTORY_DAYS = 30
PANEL_NOTE_ROWS = 5
DIGEST_HOSTS = 4
ACTION_ROWS = 3
TOP_OPPORTUNITIES = 5
THIN_SAMPLE_SHARE = 0.25
STALE_HOURS = 30

# ---------------------------------------------------------------- fixed values
# Request paths that are never a person reading something.
NON_CONTENT_PATTERN = (
    r"(?is)^(?:/robots\.txt|/favicon\.ico|/sitemap[^/]*"
    r"|/\.well-known(?:/.*)?|/cdn-cgi(?:/.*)?)\z"
)

# ---------------------------------------------------------------- fixed values
# Shapes of a malformed URL: an angle bracket, raw or percent-encoded; a bare
# markup tag as a path segment; a scheme prefix (left out of the doubled-slash
# test); and every percent sequence that decodes to well-formed UTF-8.
ANGLE_PATTERN = r"(?i)%3[ce]|[<>]"
BARE_TAG_PATTERN = r"(?i)/(?:span|iframe|noscript)(?:%3e|>|/|\z)"
SCHEME_PATTERN = r"(?i)^[a-z][a-z0-9+.-]*://"
DECODABLE_PATTERN = (
    r"(?i)%[0-7][0-9a-f]"
    r"|%(?:c[2-9a-f]|d[0-9a-f])%[89ab][0-9a-f]"
    r"|%e0%[ab][0-9a-f]%[89ab][0-9a-f]"
    r"|%(?:e[1-9a-c]|e[ef])%[89ab][0-9a-f]%[89ab][0-9a-f]"
    r"|%ed%[89][0-9a-f]%[89ab][0-9a-f]"
    r"|%f0%[9ab][0-9a-f]%[89ab][0-9a-f]%[89ab][0-9a-f]"
    r"|%f[1-3]%[89ab][0-9a-f]%[89ab][0-9a-f]%[89ab][0-9a-f]"
    r"|%f4%8[0-9a-f]%[89ab][0-9a-f]%[89ab][0-9a-f]"
)

# ---------------------------------------------------------------- fixed values
# Expected click-through rate by search position: (position, rate).
CTR_ANCHORS = (
    (1, 0.285), (2, 0.150), (3, 0.110), (10, 0.025), (15, 0.015),
    (20, 0.010), (30, 0.006), (50, 0.003), (100, 0.001),
)

# ---------------------------------------------------------------- fixed values
# Search-opportunity thresholds.
TARGET_POSITION = 5.0
SNIPPET_MAX_POSITION = 15.0
RANK_MAX_POSITION = 50.0
OPPORTUNITY_MIN_IMPRESSIONS = 5
POSITION_MIN_IMPRESSIONS = 10
SNIPPET_CTR_RATIO = 0.5
MIN_ACTIONABLE_CLICKS = 0.5
TOP_TEN = 10.0

# ---------------------------------------------------------------- fixed values
# Signal thresholds.
SIGNAL_MIN_ABSOLUTE_CHANGE = 25
RISE_MIN_DELTA = 0.25
DROP_MAX_DELTA = -0.25
SUBFLOOD_MIN_DELTA = 1.0
SUBFLOOD_MIN_ABSOLUTE_CHANGE = 50
SUBFLOOD_MIN_VISITS = 100
SUBFLOOD_DIRECT_SHARE = 0.8
SUBFLOOD_TOP_PAGE_SHARE = 0.8
ERROR_BASELINE_DAYS = 14
ERROR_MIN_BASELINE_DAYS = 3
ERROR_SPIKE_MULTIPLE = 2.0
ERROR_SPIKE_POINTS = 0.05
ERROR_MIN_SHARE = 0.02
ERROR_MIN_REQUESTS = 50
MALFORMED_MIN_PATHS = 3
MALFORMED_WEIGHT = 10
ESCALATE_RECURRENCE = 3

# ---------------------------------------------------------------- fixed values
# Search data covers date-4 .. date-2, written with an en dash.
SEARCH_LAG_START = 4
SEARCH_LAG_END = 2
WINDOW_DASH = "–"

# ---------------------------------------------------------------- fixed values
# Run-log texts and lengths.
RUN_OK_NOTE = "ok"
NOTE_SEPARATOR = " | "
NOTE_LENGTH = 140
AUTH_NOTE_LENGTH = 160
NO_RESPONSE = "no response"
# What a note about a failed pull begins with, by source, in the order of the notes.
PULL_NOTES = {
    "beacons": "beacons", "zone": "zone traffic", "forums": "forum activity",
    "keywords": "gsc queries", "search_pages": "gsc pages", "search_summary": "gsc summary",
}
MAX_NOTES = 200
SEARCH_NOTE_PREFIX = "gsc "
SEARCH_AUTH_PREFIX = "gsc auth"

# ---------------------------------------------------------------- fixed values
# Display names.
CHANNEL_LABELS = {
    "search": "search", "direct": "direct", "social": "social", "ref": "referral",
    "internal": "internal", "ai": "AI",
}
DIRECT_LABEL = "Direct / none"
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")
DISPLAY_ZONE = "America/Denver"

# ---------------------------------------------------------------- fixed values
# Report wording. {names} are filled in per row.
FLOOD_REASON = "{direct} direct, {rate} pages/session, {multiple}x a normal day"
COVERAGE_NOTE = "{days} of {period} daily snapshots available"
SNIPPET_REASON = (
    "Ranks at {position} with {ctr} CTR against roughly {expected} expected there: about {clicks}"
    " clicks a window lost to the snippet, not to the ranking."
    " Rewrite the title and meta description."
)
RANK_REASON = (
    "Ranks at {position}, too deep to be seen. Roughly {clicks} clicks a window are out of reach"
    " at that rank. Strengthen the page and link to it."
)
ZONE_NOTE = "{requests} requests · {visits} zone visits · {bytes}"
CLEAN_DAYS_NOTE = "Human figures above cover the {days} clean {day_word}"
NOTHING_RECOVERED = "; the flooded {day_word} produced no referred sessions at all."
NOTHING_MEASURED = (
    "No referred sessions were measured on those days, so there is no human figure to report."
)
RECOVERED_NOTE = "{sessions} referred {session_word} that survived the flooded {day_word}"
RECOVERED_ONLY = "The figure above is the "
RECOVERED_WHY = (
    ". A crawler arrives without a referer, so a referral is still a person; the direct traffic"
    " on those days is not separable, which is why the total is a floor."
)
HEADLINES = {
    "error-spike": "{host} error responses are {share} of requests",
    "likely-bot-subflood": "{host} is up {delta}, and it looks like a crawler rather than growth",
    "malformed-urls": "{host} is serving {count} malformed URLs",
    "snippet-gap": "{host} has {count} {query_word} ranking well but not clicked",
    "rank-gap": "{host} has {count} {query_word} ranking too deep to be seen",
    "traffic-drop": "{host} sessions fell {delta}",
    "traffic-rise": "{host} sessions rose {delta}",
    "no-comparison": "{host} has no like-for-like comparison",
}
EVIDENCE = {
    "error-spike": (
        "{errors} responses ≥ 400 out of {requests} requests, against a {days}-day mean of {mean}."
    ),
    "likely-bot-subflood": (
        "{visits} sessions (was {previous}), {direct} direct, {rate} pages/session,"
        " {top_share} of entrances on {top_page}."
    ),
    "malformed-urls": (
        "{count} landing pages contain encoded markup or tag fragments, e.g. {example}."
    ),
    "snippet-gap": (
        'About {clicks} clicks a window are going elsewhere, led by "{query}" at position'
        " {position} with {ctr} CTR against roughly {expected} expected there."
    ),
    "rank-gap": (
        'Roughly {clicks} clicks a window are out of reach at these ranks, led by "{query}"'
        " at position {position} on {impressions} impressions."
    ),
    "traffic-drop": "{visits} sessions, down {change} from {previous}.",
    "traffic-rise": "{visits} sessions, up {change} from {previous}.",
    "no-comparison": (
        "{visits} sessions is a floor: {side} period contains a crawler-flooded day whose direct"
        " bucket is not separable."
    ),
}
# ---------------------------------------------------------------- fixed values
# The imperative sentence that goes with each signal.
ACTIONS = {
    "error-spike": "Check the top failing paths below and fix or redirect them.",
    "likely-bot-subflood": (
        "Treat as crawler traffic, not growth, and consider lowering the flood floor for this host."
    ),
    "malformed-urls": (
        "Fix the broken links generating these, then redirect or noindex the junk URLs."
    ),
    "snippet-gap": (
        "Rewrite the title and meta description for those pages; the ranking is already there."
    ),
    "rank-gap": (
        "Strengthen those pages and link to them from the strongest related page on the site."
    ),
    "traffic-drop": "Compare the referrer list against the previous period to find what stopped.",
    "traffic-rise": "Check which referrer drove it before counting it as growth.",
    "no-comparison": (
        "Read the figure as a floor, and wait for a clean day before judging the trend."
    ),
}
