"""Ranked signals: what happened on a site that somebody should act on.

Each rule is a struct column over one row of facts per site, NULL where it does
not fire. All wanted rules are put in one array and exploded, so any number of
rules is a single pass over the sites.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.config import SignalRules
from tidegauge.functions.ranking import site_keys
from tidegauge.functions.scalars import anchor, is_malformed
from tidegauge.functions.text import fixed, literal, number, percent, plural, sentence

# Order of the rules for one site; decides ties.
RUM_RULES = (
    "likely-bot-subflood", "malformed-urls", "snippet-gap", "rank-gap",
    "traffic-drop", "traffic-rise", "no-comparison",
)
ZONE_RULES = ("error-spike",)
ALL_RULES = ZONE_RULES + RUM_RULES


# ------------------------------------------------------------------ the facts


def error_series(statuses: DataFrame, traffic: DataFrame) -> DataFrame:
    """Share of error responses per measured day; a day without rows is absent."""
    keys = [*site_keys(traffic), "date"]
    errors = statuses.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("status") >= 400, F.col("requests"))), F.lit(0)).alias(
            "error_requests"
        )
    )
    return (
        traffic.where(F.col("views") > 0)
        .select(*keys, F.col("views").alias("requests"))
        .join(errors, keys)
        .withColumn("error_share", F.col("error_requests") / F.col("requests"))
    )


def error_facts(series: DataFrame, rules: SignalRules = SignalRules()) -> DataFrame:
    """The report date's error share beside the mean of the measured days before it."""
    keys = site_keys(series)
    before = W.partitionBy(*keys).orderBy("date").rowsBetween(-rules.error_days, -1)
    return (
        series.withColumn("error_mean", F.avg("error_share").over(before))
        .withColumn("error_days", F.count("*").over(before))
        .where(F.col("date") == F.col("as_of"))
        .select(
            *keys,
            F.col("requests").alias("error_base"),
            "error_requests",
            "error_share",
            "error_mean",
            "error_days",
        )
    )


def landing_facts(card: DataFrame) -> DataFrame:
    """Busiest page, listed entrances and malformed paths of a site's landing card."""
    malformed = is_malformed(F.col("page"))
    return card.groupBy(*site_keys(card)).agg(
        F.min_by("page", "rank").alias("top_page"),
        F.min_by("visits", "rank").alias("top_entries"),
        F.sum("visits").alias("listed_entries"),
        F.count_if(malformed).alias("malformed_count"),
        F.min_by(F.when(malformed, F.col("page")), F.when(malformed, F.col("rank"))).alias(
            "malformed_example"
        ),
    )


# ------------------------------------------------------------------ the rules


def _signal(
    kind: str, severity: int, fires: Column, weight: str, parts: dict[str, str],
    recurrence: str = "NULL",
) -> Column:
    """The signal as a struct, NULL where the rule does not fire."""
    headline = sentence(C.HEADLINES[kind], host="host", **parts)
    evidence = sentence(C.EVIDENCE[kind], **parts)
    signal = F.expr(
        f"named_struct('severity', {severity}, 'kind', '{kind}', 'headline', {headline},"
        f" 'evidence', {evidence}, 'action', {literal(C.ACTIONS[kind])},"
        f" 'recurrence', int({recurrence}), 'weight', double({weight}),"
        f" 'rule_order', {ALL_RULES.index(kind)})"
    )
    return F.when(fires, signal)


CHANGE = "visits - previous_visits"
DIRECT_SHARE = "IF(visits != 0, direct / visits, 0D)"
TOP_SHARE = (
    "coalesce(top_entries / nullif(greatest(coalesce(listed_entries, 0), visits), 0), 0D)"
)


def top_landing_share() -> Column:
    """Share of the busiest page, over the larger of listed entrances and sessions."""
    return F.expr(TOP_SHARE)


def _error_spike(rules: SignalRules) -> Column:
    fires = F.expr(
        f"error_days >= {rules.error_min_days} AND error_requests >= {rules.error_min_requests}"
        f" AND error_share >= {rules.error_min_share}D"
        f" AND (error_share >= error_mean * {rules.error_multiple}D"
        f" OR error_share - error_mean >= {rules.error_points}D)"
    )
    parts = {
        "share": percent("error_share", 1),
        "errors": number("error_requests"),
        "requests": number("error_base"),
        "days": "string(error_days)",
        "mean": percent("error_mean", 1),
    }
    return _signal("error-spike", 1, fires, "error_requests", parts)


def _is_subflood(rules: SignalRules) -> Column:
    return F.expr(
        f"delta >= {rules.subflood_delta}D AND {CHANGE} >= {rules.subflood_change}"
        f" AND visits >= {rules.subflood_visits}"
        f" AND pages_per_session > 0 AND pages_per_session <= {rules.subflood_flat_pages}D"
        f" AND {DIRECT_SHARE} >= {rules.subflood_direct_share}D"
        f" AND {TOP_SHARE} >= {rules.subflood_top_page_share}D"
    )


def _subflood(rules: SignalRules) -> Column:
    parts = {
        "delta": percent("delta"),
        "visits": number("visits"),
        "previous": number("previous_visits"),
        "direct": percent(DIRECT_SHARE),
        "rate": fixed("pages_per_session", 1),
        "top_share": percent(TOP_SHARE),
        "top_page": "top_page",
    }
    return _signal("likely-bot-subflood", 1, _is_subflood(rules), f"abs({CHANGE})", parts)


def _malformed(rules: SignalRules) -> Column:
    fires = F.col("malformed_count") >= rules.malformed_min_paths
    weight = f"malformed_count * {C.MALFORMED_WEIGHT}"
    parts = {"count": "string(malformed_count)", "example": "malformed_example"}
    return _signal("malformed-urls", 2, fires, weight, parts)


def _gap(kind: str) -> Column:
    count, lead = f"{kind}_count", f"{kind}_lead"
    parts = {
        "count": f"string({count})",
        "query_word": plural(count, "query", "queries"),
        "clicks": fixed(f"{kind}_clicks", 1),
        "query": f"{lead}.query",
        "position": fixed(f"{lead}.position", 1),
        "ctr": percent(f"{lead}.ctr", 1),
        "expected": percent(f"{lead}.expected_ctr", 1),
        "impressions": number(f"{lead}.impressions"),
    }
    return _signal(f"{kind}-gap", 2, F.col(count) > 0, f"{kind}_clicks", parts)


def _movement(kind: str, severity: int, fires: Column) -> Column:
    parts = {
        "delta": percent("abs(delta)"),
        "visits": number("visits"),
        "change": number(f"abs({CHANGE})"),
        "previous": number("previous_visits"),
    }
    return _signal(kind, severity, fires, f"abs({CHANGE})", parts)


def _drop(rules: SignalRules) -> Column:
    fires = F.expr(f"delta <= {rules.drop_delta}D AND abs({CHANGE}) >= {rules.min_change}")
    return _movement("traffic-drop", 2, fires)


def _rise(rules: SignalRules) -> Column:
    rises = F.expr(f"delta >= {rules.rise_delta}D AND abs({CHANGE}) >= {rules.min_change}")
    return _movement("traffic-rise", 3, rises & ~F.coalesce(_is_subflood(rules), F.lit(False)))


def _no_comparison(period_days: int) -> Column:
    fires = F.expr("delta IS NULL AND (partial_days > 0 OR previous_partial_days > 0)")
    parts = {
        "visits": number("visits"),
        "side": "IF(partial_days > 0, 'this', 'the previous')",
    }
    run = "flood_run" if period_days == 1 else "NULL"
    return _signal("no-comparison", 3, fires, "visits", parts, run)


def signals(
    facts: DataFrame,
    rules: SignalRules = SignalRules(),
    period_days: int = 1,
    only: Sequence[str] = ALL_RULES,
) -> DataFrame:
    """Signals of every site; ``only`` limits the rules, and with them the facts needed."""
    column = {
        "error-spike": lambda: _error_spike(rules),
        "likely-bot-subflood": lambda: _subflood(rules),
        "malformed-urls": lambda: _malformed(rules),
        "snippet-gap": lambda: _gap("snippet"),
        "rank-gap": lambda: _gap("rank"),
        "traffic-drop": lambda: _drop(rules),
        "traffic-rise": lambda: _rise(rules),
        "no-comparison": lambda: _no_comparison(period_days),
    }
    is_zone = F.col("measurement") == "zone"
    fired = [
        F.when(is_zone if name in ZONE_RULES else ~is_zone, column[name]()) for name in only
    ]
    # The outer form keeps Spark from adding a filter that repeats every rule.
    return (
        facts.withColumn("signal", F.explode_outer(F.array(*fired)))
        .where(F.col("signal").isNotNull())
        .select(*site_keys(facts), "signal.*")
        .withColumn("href", F.concat(F.lit("#"), anchor(F.col("host"))))
    )


def rank_signals(found: DataFrame) -> DataFrame:
    return found.orderBy(
        *[k for k in ("as_of",) if k in found.columns],
        "severity", F.desc("weight"), "host", "rule_order",
    )


def todays_actions(found: DataFrame, n: int = C.ACTION_ROWS) -> DataFrame:
    return rank_signals(found.where(F.col("severity") <= 2)).limit(n)


def top_alert(found: DataFrame) -> DataFrame:
    """The first severity-1 signal; no row when there is none."""
    return rank_signals(found.where(F.col("severity") == 1)).limit(1)


def recurrence(
    found: DataFrame, escalate_at: int = C.ESCALATE_RECURRENCE, before: DataFrame | None = None
) -> DataFrame:
    """How many days in a row before its own each signal fired, over tagged reports.

    Signals of consecutive report dates form an island: the date minus its
    position in the (kind, host) series is the same for all of them. A signal
    that keeps coming back moves one severity level up.

    ``before`` holds stored signals (date, kind, host, recurrence): an island that
    begins the day after one of them continues its count. So the history before the
    first report date need not be computed again, and one date of it is enough.
    """
    series = W.partitionBy("kind", "host").orderBy("as_of")
    position = F.row_number().over(series)
    island = W.partitionBy("kind", "host", "island").orderBy("as_of")
    raised = F.greatest(F.col("severity") - 1, F.lit(1))
    days = F.row_number().over(island) - 1
    counted = found.withColumn("island", F.date_sub("as_of", position))
    if before is None:
        counted = counted.withColumn("recurrence", days.cast("int"))
    else:
        # The first date of an island is one day after its name.
        start = F.min("as_of").over(W.partitionBy("kind", "host", "island"))
        seed = before.select("kind", "host", F.date_add("date", 1).alias("start"), (F.col("recurrence") + 1).alias("so_far"))
        counted = counted.withColumn("recurrence", days.cast("int")).withColumn("start", start)
        counted = counted.join(seed, ["kind", "host", "start"], "left").withColumn(
            "recurrence", (F.col("recurrence") + F.coalesce("so_far", F.lit(0))).cast("int")
        ).select(*counted.columns).drop("start")
    return counted.withColumn(
        "severity",
        F.when(F.col("recurrence") >= escalate_at, raised).otherwise(F.col("severity")),
    ).drop("island")
