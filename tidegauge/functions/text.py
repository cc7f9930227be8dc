"""Number formats and sentences, as SQL text for ``F.expr``.

A sentence has many small parts. One SQL string per sentence keeps a plan with
dozens of them quick to build, and the wording stays readable.
"""

from __future__ import annotations

import re

from tidegauge import constants as C


def literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sentence(template: str, **parts: str) -> str:
    """SQL that fills the ``{names}`` of a template with SQL expressions."""
    pieces = re.split(r"\{(\w+)\}", template)
    terms = [parts[p] if i % 2 else literal(p) for i, p in enumerate(pieces) if i % 2 or p]
    return f"concat({', '.join(terms)})"


def fixed(value: str, digits: int) -> str:
    """Decimal text, rounded half up on the exact binary value of a double.

    ``format_string`` rounds the shortest decimal form, so 8.85 (which is below
    8.85 in binary) would become 8.9. The rounding error of the scaled product is
    recovered exactly (Dekker's product) and decides such near-ties.
    """
    x = f"abs(coalesce(double({value}), 0D))"
    scale = f"{2 * 10**digits}D"
    product = f"({x} * {scale})"
    split = f"({x} * 134217729D)"
    high = f"({split} - ({split} - {x}))"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    whole = f"floor({product})"
    below_tie = f"({product} = {whole} AND {whole} % 2 = 1 AND {error} < 0)"
    units = f"(floor(({whole} + 1) / 2) - IF({below_tie}, 1, 0))"
    sign = f"IF({value} < 0, '-', '')"
    if not digits:
        return f"concat({sign}, string({units}))"
    decimals = f"lpad(string({units} % {10**digits}), {digits}, '0')"
    return f"concat({sign}, string({units} DIV {10**digits}), '.', {decimals})"


def percent(share: str, digits: int = 0) -> str:
    return f"concat({fixed(f'({share}) * 100D', digits)}, '%')"


def number(value: str) -> str:
    """Whole number with thousands separators."""
    return f"format_number(coalesce({value}, 0), 0)"


def plural(count: str, word: str, words: str) -> str:
    return f"IF({count} = 1, {literal(word)}, {literal(words)})"


def byte_size(value: str) -> str:
    """Byte count in the largest unit up to TB, base 1024."""
    n = f"coalesce({value}, 0)"
    branches = [f"WHEN {n} < 1024 THEN concat({fixed(n, 0)}, ' {C.BYTE_UNITS[0]}')"]
    for power, unit in enumerate(C.BYTE_UNITS[1:], start=1):
        scaled = f"concat({fixed(f'({n} / {1024**power}D)', 1)}, ' {unit}')"
        last = unit == C.BYTE_UNITS[-1]
        branches.append(f"ELSE {scaled}" if last else f"WHEN {n} < {1024 ** (power + 1)} THEN {scaled}")
    return f"CASE {' '.join(branches)} END"


def delta_label(
    delta: str, change: str, compact: bool = False, min_change: int = C.SIGNAL_MIN_ABSOLUTE_CHANGE
) -> str:
    tail = "" if compact else " vs previous"
    sign = f"CASE WHEN {change} > 0 THEN '+' WHEN {change} < 0 THEN '−' ELSE '±' END"
    arrow = f"CASE WHEN {delta} > 0 THEN '↑' WHEN {delta} < 0 THEN '↓' ELSE '→' END"
    small = f"concat({sign}, {number(f'abs({change})')}, '{tail}')"
    relative = f"concat({arrow}, ' ', {percent(f'abs({delta})')}, '{tail}')"
    return (
        f"CASE WHEN {delta} IS NULL THEN 'no comparison'"
        f" WHEN abs({change}) < {min_change} THEN {small} ELSE {relative} END"
    )
