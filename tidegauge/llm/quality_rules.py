"""Quality rules whose cut-offs are certified on labelled documents.

Base measures and the fixed base rule come first. Each further rule is a measure with a
grid of cut-offs; a document above the cut-off is rejected. Per stratum (band of length)
and rule, the good labelled documents above a cut-off are counted, and an exact binomial
test asks whether the true share of good documents above it is at most ``risk`` /
number of rules. The level is divided by the number of strata and rules (Bonferroni);
the cut-offs of one rule are tested in a fixed order, from the one that rejects least,
up to the first that fails, which needs no further division. So with probability 1 -
``delta`` no stratum loses more than ``risk`` of its good documents to all rules
together. Of the certified cut-offs the one with the best balance of bad against good
documents is taken; where none is certified, or labels are missing, the rule is off in
that stratum.

The counts come from one aggregate over all labelled documents outside the held-out
fold; only its table of fixed size reaches the driver. The measures are computed once,
over whole texts, and written as a narrow table.

Null and empty texts, and texts of blanks, have no words and fail the base rule.
Repeated rows are measured, and counted, as rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.labelled import held_out
from tidegauge.llm.rows import columns, map_rows, staged

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
BLANKS = " \t\n\r\x0b\x0c"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*BASE, "n_lines", "n_upper", "n_marks", "n_distinct"]
#: Lower ends of the bands of length, in words.
BANDS = (0, 100, 400)
GRID = 40
RULES = ["symbols", "upper", "dup_lines", "marks", "monotony"]


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that are found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    windows = [line[a:b] for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())]
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    twice = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, n))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: str | None) -> list[int]:
    """The values of MEASURES for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: Counter = Counter(line for line in text.split("\n") if line.strip(BLANKS))
    lines = sum(seen.values())
    return [
        len(words), len(text) - sum(text.count(b) for b in BLANKS), len(raw) - len(raw.translate(None, SYMBOLS)),
        lines - len(seen), repeated_window_words(words), lines,
        len(raw) - len(raw.translate(None, UPPER)), raw.count(b"!") + raw.count(b"?"), len(set(words)),
    ]


def measures(docs: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with every measure, and ``base_failed``."""
    def make(texts: list[str | None]) -> list[list]:
        return list(map(list, zip(*map(measure, texts)))) or [[] for _ in MEASURES]

    out = map_rows(docs, text, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]), make, keep)
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rules() -> dict:
    """Rule name -> (measure as a ratio, largest cut-off). Higher is worse."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": (F.col("n_symbols") / words, 1.0),
        "upper": (F.col("n_upper") / chars, 0.8),
        "dup_lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.8),
        "marks": (F.col("n_marks") / words, 1.0),
        "monotony": (1 - F.col("n_distinct") / words, 0.9),
    }


def band():
    """Number of the document's stratum."""
    return sum((F.col("n_words") >= b).cast("int") for b in BANDS[1:])


def cell(name: str):
    """Number of grid cut-offs that the document is above; cut-off j is top * j / GRID."""
    value, top = rules()[name]
    return F.least(F.lit(GRID), F.greatest(F.lit(0), F.ceil(value / top * GRID))).cast("int")


def certified(k: int, n: int, risk: float, level: float) -> bool:
    """Exact test: k or fewer of n at true share ``risk`` would have probability ``level`` at most.

    This is the Clopper-Pearson upper bound at that level being ``risk`` or less.
    """
    if n == 0 or k >= risk * n:
        return False
    j = np.arange(1, k + 1)
    log_choose = np.concatenate([[0.0], np.cumsum(np.log((n - j + 1) / j))])
    i = np.arange(k + 1)
    terms = log_choose + i * np.log(risk) + (n - i) * np.log1p(-risk)
    top = terms.max()
    return float(top + np.log(np.exp(terms - top).sum())) <= np.log(level)


def choose(counts: dict[tuple[int, str, int, int], int], risk: float, delta: float) -> dict[tuple[int, str], int]:
    """Cut-off number per (stratum, rule), from counts per (stratum, rule, cell, label)."""
    names, strata = RULES, range(len(BANDS))
    level = delta / (len(names) * len(BANDS))
    out = {}
    for s in strata:
        for name in names:
            above = [[sum(counts.get((s, name, c, y), 0) for c in range(j + 1, GRID + 1)) for j in range(GRID)] for y in (0, 1)]
            good = sum(counts.get((s, name, c, 1), 0) for c in range(GRID + 1))
            best = 0
            for j in reversed(range(GRID)):
                if not certified(above[1][j], good, risk / len(names), level):
                    break
                gain = above[0][j] - 5 * above[1][j]
                if gain > best:
                    out[s, name], best = j, gain
    return out


def cut_offs(measured: DataFrame, doc_id: str, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> dict[tuple[int, str], int]:
    """Certified cut-offs, from labelled rows of ``measured`` outside the held-out fold."""
    known = columns(labels, id="doc_id", y="quality").where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    rows = measured.where("NOT base_failed").join(known, F.col(f"`{doc_id}`") == F.col("id"))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), cell(n).alias("cell")) for n in RULES]))
    table = rows.select(band().alias("band"), "y", pairs.alias("p")).groupBy("band", "p.rule", "p.cell", "y").count()
    return choose({(r.band, r.rule, r.cell, int(r.y)): r["count"] for r in table.collect()}, risk, delta)


def verdict(measured: DataFrame, chosen: dict[tuple[int, str], int]) -> DataFrame:
    """``measured`` with ``failed`` (names of the rules that reject it) and ``kept``."""
    failed = [
        F.when((band() == s) & (cell(name) > j), F.lit(name)) for (s, name), j in sorted(chosen.items())
    ]
    names = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return measured.withColumn("failed", names).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def judged(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Measures and verdict of every row, by id."""
    measured = staged(measures(docs, text, keep=[doc_id]), "measures")
    return verdict(measured, cut_offs(measured, doc_id, labels, risk, delta))
