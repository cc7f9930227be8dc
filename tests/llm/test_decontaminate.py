"""Automaton against every window looked up at every word."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import decontaminate as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items, size):
    """Hit word numbers and ids of items with an occurring window."""
    w, hit, ids = plain_words(text), set(), set()
    for item, t in items:
        v = plain_words(t)
        for window in [v[i : i + size] for i in range(max(1, len(v) - size + 1))] if v else []:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    ids.add(item)
    return len(w), hit, ids


WORDS = st.lists(st.sampled_from(["a", "B", "é", "ab", "a.b", "-", "İ"]), max_size=14).map(" ".join)


@given(WORDS, st.lists(WORDS, max_size=4), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_scan_is_brute_force(text, items, size):
    items = [(str(i), t) for i, t in enumerate(items)]
    patterns = {}
    for i, t in items:
        for w in d.windows(t, size):
            patterns.setdefault(w, (w.count(b" ") + 1, set()))[1].add(i)
    n, ranges, ids = d.scan(d.automaton(patterns), text)
    words, hit, found = brute(text, items, size)
    assert (n, {k for a, b in ranges for k in range(a, b + 1)}, ids) == (words, hit, found)
    raw = text.encode()
    for first, last, start, end in d.byte_spans(text, ranges):
        assert d.words_of(raw[start:end].decode()) == d.words_of(text)[first : last + 1]


def test_odd_rows_and_several_parts(spark, odd_docs, no_docs):
    items = [(1, "word1 shared word2 shared word3 shared word4 shared word5 shared word6 shared word7 shared"), (2, "X"), (None, "other end"), (3, None), (4, "..."), (2, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 40):
        rows = d.verdict(d.find(odd_docs, "text", bench, "item_id", "text", part_bytes=size)).collect()
        assert len(rows) == odd_docs.count()
        for r in rows:
            n, hit, ids = brute(r.text, items, 13)
            assert (r.n_words, r.n_hit, r.item_ids) == (n, len(hit), sorted(str(i) for i in ids - {None}))
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
    assert d.verdict(d.find(no_docs, "text", bench, "item_id", "text")).collect() == []
    assert d.find(odd_docs, "text", bench.where("false"), "item_id", "text").where("size(spans) > 0").count() == 0
