"""Scalar functions as native Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge import constants as C


def zero(col: Column) -> Column:
    """NULL counts as zero."""
    return F.coalesce(col, F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; zero when the denominator is zero or NULL."""
    return F.when(zero(denominator) != 0, zero(numerator) / denominator).otherwise(F.lit(0.0))


def named(col: Column, empty_name: str) -> Column:
    """An explicit name for a NULL or empty dimension value."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(empty_name))


def iso_date(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def search_window(date: Column) -> Column:
    """Label of the lagged search window that a snapshot date stands for."""
    return F.concat(
        iso_date(F.date_sub(date, C.SEARCH_LAG_START)),
        F.lit(C.WINDOW_DASH),
        iso_date(F.date_sub(date, C.SEARCH_LAG_END)),
    )


def _contains_any(text: Column, fragments: Iterable[str]) -> Column:
    return text.rlike("|".join(re.escape(fragment) for fragment in fragments))


def referrer_kind(referrer: Column, internal: Column | None = None) -> Column:
    """Channel of a referrer host: direct, internal, ai, search, social or ref.

    Lists are matched as substrings of the lower-cased host, so ``t.co`` also
    matches ``reddit.com``: order decides, and it is part of the definition.
    ``internal`` says whether the referrer is one of the site's own host names.
    """
    host = F.lower(referrer)
    direct = referrer.isNull() | referrer.isin("", C.DIRECT_REFERRER)
    kind = F.when(direct, "direct")
    if internal is not None:
        kind = kind.when(internal, "internal")
    return (
        kind.when(_contains_any(host, C.AI_ANSWER_ENGINES), "ai")
        .when(_contains_any(host, C.SEARCH_ENGINES), "search")
        .when(_contains_any(host, C.SOCIAL_NETWORKS), "social")
        .otherwise("ref")
    )


def is_non_content(path: Column) -> Column:
    """Crawler-protocol, browser-asset and edge paths."""
    return F.coalesce(path.rlike(C.NON_CONTENT_PATTERN), F.lit(False))


def is_malformed(path: Column) -> Column:
    """URL shapes that a site cannot have generated itself.

    A percent sequence is undecodable when a ``%`` is left after every
    well-formed UTF-8 sequence is taken out.
    """
    without_scheme = F.regexp_replace(F.substring(path, 2, 2**31 - 1), C.SCHEME_PATTERN, "")
    undecodable = F.regexp_replace(path, C.DECODABLE_PATTERN, "").contains("%")
    return F.coalesce(
        path.rlike(C.ANGLE_PATTERN)
        | path.rlike(C.BARE_TAG_PATTERN)
        | without_scheme.contains("//")
        | (path.contains("%") & undecodable),
        F.lit(False),
    )


def expected_ctr(position: Column) -> Column:
    """Expected click-through rate: geometric interpolation between the anchors.

    The segment of a position is counted off and its parameters are looked up, so
    the generated code holds one power instead of one per segment.
    """
    (first, highest), (last, lowest) = C.CTR_ANCHORS[0], C.CTR_ANCHORS[-1]
    segments = list(zip(C.CTR_ANCHORS, C.CTR_ANCHORS[1:]))
    segment = sum(
        ((position > upper).cast("int") for _, (upper, _) in segments[1:-1]),
        (position > segments[0][1][0]).cast("int"),
    )

    def parameter(of) -> Column:
        return F.get(F.array(*[F.lit(float(of(*s))) for s in segments]), segment)

    start = parameter(lambda lower, upper: lower[0])
    width = parameter(lambda lower, upper: upper[0] - lower[0])
    rate = parameter(lambda lower, upper: lower[1])
    decay = parameter(lambda lower, upper: upper[1] / lower[1])
    known = position.isNotNull() & ~F.isnan(position) & (position != float("inf"))
    return (
        F.when(~known | (position <= first), F.lit(highest))
        .when(position >= last, F.lit(lowest))
        .otherwise(rate * F.pow(decay, (position - start) / width))
    )


def anchor(host: Column) -> Column:
    """In-page anchor of a site card."""
    return F.concat(F.lit("site-"), F.regexp_replace(host, "[^a-zA-Z0-9]", "-"))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def page_label(page: Column) -> Column:
    """Path and query of an absolute URL; anything else unchanged."""
    absolute = r"(?is)^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)(\?[^#]+)?"
    path = named(F.regexp_extract(page, absolute, 1), C.ROOT_PATH)
    query = F.regexp_extract(page, absolute, 2)
    return F.when(page.rlike(absolute), F.concat(path, query)).otherwise(page)


def referrer_label(referrer: Column) -> Column:
    return F.when(referrer == C.DIRECT_REFERRER, C.DIRECT_LABEL).otherwise(referrer)


def kind_label(kind: Column) -> Column:
    label = reduce(
        lambda chain, item: chain.when(kind == item[0], item[1]),
        C.CHANNEL_LABELS.items(),
        F.when(F.lit(False), ""),
    )
    return label.otherwise("referral")


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def delta_class(delta: Column, change: Column, min_change: int = C.SIGNAL_MIN_ABSOLUTE_CHANGE) -> Column:
    return (
        F.when(delta.isNull(), "none")
        .when(F.abs(change) < min_change, "small")
        .when(delta > 0, "up")
        .when(delta < 0, "down")
        .otherwise("neutral")
    )


def date_label(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "MMM d, yyyy"), F.lit("—"))


def timestamp_label(ts: Column) -> Column:
    """Local display time with the zone's short name; ``ts`` is a UTC timestamp."""
    local = F.from_utc_timestamp(ts, C.DISPLAY_ZONE)
    summer = (F.unix_timestamp(local) - F.unix_timestamp(ts)) == -6 * 3600
    zone = F.when(summer, " MDT").otherwise(" MST")
    return F.coalesce(
        F.concat(F.date_format(local, "MMM d, h:mm a"), zone), F.lit("not yet available")
    )
