"""Benchmark decontamination by one Aho-Corasick automaton over the test items.

Texts are normalised the same way on both sides: A-Z lower-cased, every other ASCII
character but digits and a-z is a break, bytes of other scripts belong to words. An
item gives its windows of ``words`` words, or itself if it has fewer; each window is a
pattern with breaks at both ends. A document is scanned once, and the places found are
mapped back to word numbers and to byte offsets of the original text.

The items are the small side by nature, and that is checked: above ``part_bytes`` of
text they are cut into parts by item, each with its own automaton, and the documents
pass through one narrow step per part. So no automaton outgrows a worker, and nothing
is shuffled.

Null texts and texts without a word have no windows and no hits. An item id that is
null still finds contaminated words but is not listed. Repeated items, and equal
windows of different items, count for each of the items.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.rows import columns, map_rows

#: Bytes to bytes: A-Z to a-z, other ASCII that is no digit or letter to a space.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "last_word", "start", "end")])
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows(text: str | None, words: int) -> set[bytes]:
    """The windows of an item: ``words`` consecutive words, or all if there are fewer."""
    w = words_of(text)
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def automaton(patterns: dict[bytes, tuple[int, set[str]]]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for pattern, what in patterns.items():
        auto.add_word(f" {pattern.decode('latin-1')} ", what)
    auto.make_automaton()
    return auto


def scan(auto: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged [first, last] word ranges that are hit, and item ids."""
    w = words_of(text)
    if not w or not len(auto):
        return len(w), [], set()
    line = f" {b' '.join(w).decode('latin-1')} "
    found = list(auto.iter(line))
    if not found:
        return len(w), [], set()
    ends = np.searchsorted(np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32), [f[0] for f in found]) - 1
    ranges: list[list[int]] = []
    for first, last in sorted({(int(e) - f[1][0] + 1, int(e)) for e, f in zip(ends, found)}):
        if ranges and first <= ranges[-1][1] + 1:
            ranges[-1][1] = max(ranges[-1][1], last)
        else:
            ranges.append([first, last])
    return len(w), [(a, b) for a, b in ranges], set().union(*(f[1][1] for f in found))


def byte_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Word ranges with the bytes of the original text that they cover."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(NORMAL), np.uint8)
    word = np.concatenate([[False], b != 32, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return [(first, last, int(edges[2 * first]), int(edges[2 * last + 1])) for first, last in ranges]


def find(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 13, part_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with n_words, the merged ``spans`` found and the sorted ``item_ids``.

    A span has the first and last word number (from 0) and the start and end byte.
    """
    bench = columns(items, item_id=item_id, item_text=item_text).select(F.col("item_id").cast("string").alias("item_id"), "item_text")
    size = bench.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    none = F.array().cast(FOUND[1].dataType)
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": none, "item_ids": F.array().cast("array<string>")})
    for part in range(parts):
        patterns: dict[bytes, tuple[int, set[str]]] = {}
        mine = bench if parts == 1 else bench.where(F.pmod(F.xxhash64("item_text"), F.lit(parts)) == part)
        for row in mine.toLocalIterator():
            for w in windows(row.item_text, words):
                patterns.setdefault(w, (w.count(b" ") + 1, set()))[1].update([] if row.item_id is None else [row.item_id])
        out = one_part(out, text, patterns)
    return out


def one_part(docs: DataFrame, text: str, patterns: dict[bytes, tuple[int, set[str]]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    held: list[ahocorasick.Automaton] = []

    def make(texts: list[str | None]) -> list[list]:
        if not held:
            held.append(automaton(shared.value))
        found = [scan(held[0], t) for t in texts]
        spans = [byte_spans(t, f[1]) if f[1] else [] for t, f in zip(texts, found)]
        keys = SPAN.fieldNames()
        return [[f[0] for f in found], [[dict(zip(keys, s)) for s in one] for one in spans], [sorted(f[2]) for f in found]]

    new = [T.StructField(f"part_{f.name}", f.dataType) for f in FOUND]
    out = map_rows(docs, text, T.StructType(new), make)
    return out.withColumns({
        "n_words": F.col("part_n_words"),
        "spans": F.concat("spans", "part_spans"),
        "item_ids": F.array_sort(F.array_union("item_ids", "part_item_ids")),
    }).drop(*[f.name for f in new])


def hit_words(spans):
    """Words inside any of the spans, which may overlap when items came in parts."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("last"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda a, s: F.struct(
            (a.n + F.greatest(s.last_word - F.greatest(s.first_word, a.last + 1) + 1, F.lit(0).cast("long"))).alias("n"),
            F.greatest(a.last, s.last_word).alias("last"),
        ),
        lambda a: a.n,
    )


def verdict(found: DataFrame, least_share: float = 0.05) -> DataFrame:
    """``n_hit``, ``n_items`` and ``contaminated``: hit words are 5 % of all, or more."""
    n_hit = hit_words(F.col("spans"))
    per = round(1 / least_share)
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("item_ids").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (per * F.col("n_hit") >= F.col("n_words"))
    )
