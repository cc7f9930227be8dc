"""Search opportunities: rows that rank but are not clicked, and rows that rank too deep."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import constants as C
from tidegauge.config import OpportunityRules
from tidegauge.functions.ranking import site_keys, top_n
from tidegauge.functions.scalars import expected_ctr, ratio, zero
from tidegauge.functions.text import fixed, percent, sentence


def mark_denied(keywords: DataFrame, deny: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mark queries that match one of their site's deny patterns, in any case.

    Patterns are configuration: each distinct one is a literal, compiled once.
    """
    hosts: dict[str, list[str]] = {}
    for host, patterns in deny.items():
        for pattern in patterns:
            hosts.setdefault(pattern, []).append(host)
    query = F.col("query")
    matches = [F.col("host").isin(sorted(set(own))) & query.rlike(f"(?i){p}") for p, own in hosts.items()]
    matched = reduce(Column.__or__, matches, F.lit(False))
    return keywords.withColumn("denied", F.coalesce((query != "") & matched, F.lit(False)))


def drop_denied(keywords: DataFrame, deny: Mapping[str, Sequence[str]]) -> DataFrame:
    return mark_denied(keywords, deny).where(~F.col("denied")).drop("denied")


def classify_keywords(
    keywords: DataFrame,
    deny: Mapping[str, Sequence[str]] | None = None,
    rules: OpportunityRules = OpportunityRules(),
) -> DataFrame:
    """Every keyword row with the opportunity that it is, or NULL.

    snippet: clicks lost at the present position. rank: clicks to be had at the
    target position. The two are never ranked by one metric.
    """
    rows = keywords.withColumn("denied", F.lit(False)) if deny is None else mark_denied(keywords, deny)
    impressions, position = zero(F.col("impressions")), zero(F.col("position"))
    clicks = zero(F.col("clicks"))
    eligible = (
        (position > 0)
        & (position <= rules.rank_max_position)
        & (impressions >= rules.min_impressions)
        & ~F.col("denied")
    )
    at_target = expected_ctr(F.lit(float(rules.target_position)))
    snippet = position <= rules.snippet_max_position
    underperforms = F.col("ctr") < F.col("expected_ctr") * rules.ctr_ratio
    lost = impressions * (F.col("expected_ctr") - F.col("ctr"))
    potential = impressions * at_target - clicks
    score = F.when(eligible & snippet & underperforms, lost).when(eligible & ~snippet, potential)
    found = F.col("score") >= rules.min_clicks
    return (
        rows.withColumns({"ctr": ratio(clicks, impressions), "expected_ctr": expected_ctr(position)})
        .withColumn("score", score)
        .withColumns(
            {
                "kind": F.when(found, F.when(snippet, "snippet").otherwise("rank")),
                "lost_clicks": F.when(found & snippet, F.col("score")),
                "potential_clicks": F.when(found & ~snippet, F.col("score")),
                "score": F.when(found, F.col("score")),
            }
        )
        .drop("denied")
    )


def opportunities(
    keywords: DataFrame,
    deny: Mapping[str, Sequence[str]] | None = None,
    rules: OpportunityRules = OpportunityRules(),
) -> DataFrame:
    """The keyword rows that are an opportunity, with their class and its own score.

    A filter on ``kind`` would be pushed below the projections with the whole
    classification written out inside it, too large to be compiled to machine
    code. Generating one row per opportunity keeps each expression where it is.
    """
    seen = (
        (F.col("position") > 0)
        & (F.col("position") <= rules.rank_max_position)
        & (F.col("impressions") >= rules.min_impressions)
    )
    rows = classify_keywords(keywords.where(seen), deny, rules)
    kind = F.explode_outer(F.array("kind"))
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull())


def rank_opportunities(found: DataFrame) -> DataFrame:
    """Every opportunity in report order.

    A range-partitioned sort whose key goes down to the query: one busy site is
    spread over as many tasks as its rows need.
    """
    return found.orderBy(*site_keys(found), "kind", F.desc("score"), "query")


def top_opportunities(found: DataFrame, n: int = C.TOP_OPPORTUNITIES) -> DataFrame:
    """The ``n`` best of each class over all sites."""
    order = [F.desc("score"), F.asc("host"), F.asc("query")]
    return top_n(found, [k for k in ("as_of", "kind") if k in found.columns], order, n)


def opportunity_reason() -> Column:
    parts = {
        "position": fixed("position", 1),
        "ctr": percent("ctr", 1),
        "expected": percent("expected_ctr", 1),
        "clicks": fixed("score", 1),
    }
    return F.expr(
        f"CASE kind WHEN 'snippet' THEN {sentence(C.SNIPPET_REASON, **parts)}"
        f" WHEN 'rank' THEN {sentence(C.RANK_REASON, **parts)} END"
    )


def flag_keywords(classified: DataFrame) -> DataFrame:
    """Every keyword row with whether it is an opportunity, and why."""
    return classified.withColumn("reason", opportunity_reason()).withColumn(
        "is_opportunity", F.col("kind").isNotNull()
    )


def opportunity_facts(found: DataFrame) -> DataFrame:
    """Per site and class: count, sum of the class metric, and the leading query.

    The lead is one aggregate over (score, query), combined inside the tasks;
    no ranking of a site's rows is needed.
    """
    keys = site_keys(found)
    # Highest score first, then the smaller query: min over the negated score.
    lead = F.struct(
        (-F.col("score")).alias("minus_score"), "query", "position", "ctr", "expected_ctr",
        "impressions",
    )

    def facts(kind: str) -> list[Column]:
        here = F.col("kind") == kind
        return [
            F.count_if(here).alias(f"{kind}_count"),
            F.sum(F.when(here, F.col("score"))).alias(f"{kind}_clicks"),
            F.min(F.when(here, lead)).alias(f"{kind}_lead"),
        ]

    return found.groupBy(*keys).agg(*facts("snippet"), *facts("rank"))


def opportunity_columns(c: Callable[[str], Column] = F.col) -> list[Column]:
    """Counts of classified keyword rows; those without a class do not count."""
    return [
        F.count(c("kind")).alias("opportunities"),
        F.count_if(c("kind") == "snippet").alias("snippet"),
        F.count_if(c("kind") == "rank").alias("rank"),
    ]


def opportunity_totals(found: DataFrame) -> DataFrame:
    return found.agg(*opportunity_columns())


def headline_site(facts: DataFrame) -> DataFrame:
    """The site whose leading snippet (else rank) opportunity scores highest."""
    minus_score = F.coalesce("snippet_lead.minus_score", "rank_lead.minus_score")
    best = F.min(F.struct(minus_score.alias("minus_score"), "host"))
    return facts.agg(best.alias("best")).select(
        F.col("best.host").alias("host"), (-F.col("best.minus_score")).alias("score")
    )
