"""Quality rules, both classifiers, licenses, archives and page texts."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.llm import html_text, licenses, quality_model, quality_rules, toxicity, warc
from tidegauge.llm.labelled import sample

BLANK = r"[^\x20\x09-\x0D]+"


def plain_measures(text):
    text = text or ""
    w = re.findall(BLANK, text)
    count, cover, seen, dup = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set(), set(), 0
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            cover.update(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(BLANK, line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


@given(st.text(alphabet="ab#|\n \t\x0b é\x1c\x85", max_size=120))
@settings(max_examples=300, deadline=None)
def test_measures(text):
    assert quality_rules.measure(text)[:5] == plain_measures(text)


def test_exact_bound():
    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for n, k in ((1, 0), (50, 0), (500, 0), (500, 1), (500, 4), (3000, 20)):
        for risk in (0.01, 0.02, 0.2):
            assert quality_rules.certified(k, n, risk, 0.01) == (k < risk * n and tail(k, n, risk) <= 0.01)
    assert not quality_rules.certified(0, 0, 0.1, 0.1)


def test_cut_offs_stop_at_the_first_that_fails():
    good, bad = {(0, "symbols", 0, 1): 4000, (0, "symbols", 20, 1): 2000}, {(0, "symbols", 40, 0): 50, (0, "symbols", 10, 0): 50}
    chosen = quality_rules.choose({**good, **bad}, 0.05, 0.05)
    # Below 20 a third of the good ones would go, though the bad ones at 10 are many.
    assert 20 <= chosen[0, "symbols"] < 40 and len(chosen) == 1
    assert quality_rules.choose({}, 0.05, 0.05) == {}


def test_rules_on_odd_rows(odd_docs, no_docs, labels):
    rows = quality_rules.judged(odd_docs.select("doc_id", "text"), "doc_id", "text", labels).collect()
    assert len(rows) == odd_docs.count() and all(r.kept == (not r.base_failed and not r.failed) for r in rows)
    measured = quality_rules.measures(odd_docs, "text").collect()
    for r in measured:
        own = plain_measures(r.text)
        assert [r[m] for m in quality_rules.BASE] == own
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
    assert quality_rules.judged(no_docs, "doc_id", "text", labels.where("false")).collect() == []


def test_field_marginals_are_sums_over_all_tags():
    field = toxicity.Field()
    field.move = np.array([[0.3, -0.5], [-0.2, 0.9]])
    scores, sizes = np.array([[0.2, -1.0], [1.5, 0.4], [-0.7, 0.0]]), np.array([3, 2])
    got, moves = field.marginals(scores, sizes)
    expected = np.zeros((2, 2))
    for col, n in enumerate(sizes):
        total, p, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for bits in range(1 << n):
            tags = [bits >> t & 1 for t in range(n)]
            w = math.exp(sum(scores[t, col] * tags[t] for t in range(n)) + sum(field.move[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            p += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                pair[a, b] += w
        assert np.allclose(got[:n, col], p / total)
        expected += pair / total
    assert np.allclose(moves, expected) and got[2, 1] == 0


def made_texts(n=240):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    out = []
    for i in range(n):
        own = [words[k] for k in rng.integers(0, 200, 30)]
        if i % 3 == 0:
            own[int(rng.integers(0, 30))] = "blockhead"
            own[int(rng.integers(0, 30))] = "blockhead"
        out.append((" ".join(own), int(i % 3 == 0)))
    return out


def test_toxic_words_are_found_and_scored(spark):
    model = toxicity.fit(made_texts())
    rows = [(1, "wabx wbax Blockhead, wcax blockhead!"), (2, "wabx wbax wcax"), (3, None), (4, ""), (5, "123 !")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), "text", model).collect()}
    assert got[1].score > 0.7 > 0.3 > got[2].score
    assert [rows[0][1][s.start : s.end] for s in got[1].spans] == ["Blockhead", "blockhead"] and not got[2].spans
    assert got[3].score == got[4].score == got[5].score < 0.5


def test_scores_do_not_follow_the_balance_of_the_sample(spark):
    """The mean score of a sample with as many toxic rows as others is that of the labels."""
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    # A word that half of the toxic documents and some of the others have.
    rows = [(i, int(i % 10 == 0), "wabx wbax " + ("blockhead " if i % 20 == 0 or i % 101 == 1 else "") + f"wcax w{i % 7}x") for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    share = sum(y for _, y, _ in rows) / len(rows)
    means = []
    for most in (4000, 30):
        model = toxicity.learn(df, "doc_id", "text", df, per_class=most)
        means.append(toxicity.score(df, "text", model).agg(F.avg("score")).first()[0])
    assert all(abs(m - share) < 0.06 for m in means), (means, share)
    # Too long to be learnt from: the share of the labels, not that of what is left.
    none = df.withColumn("text", F.when(F.col("toxic") == 0, F.repeat("text", 100)).otherwise(F.col("text")))
    assert abs(toxicity.learn(none, "doc_id", "text", df, max_bytes=500).score(np.zeros(0)) - share) < 1e-9


def test_long_texts_take_part_as_a_whole():
    model = toxicity.fit(made_texts())
    p = model.marginals([["wabx"] * 30_000 + ["blockhead"], ["wabx"], []])
    assert p[0][-1] > 0.5 and p[0][:-1].max() < 0.5 and len(p[0]) == 30_001 and len(p[2]) == 0


@pytest.mark.parametrize("chunk", [1 << 17, 1000, 7])
def test_blocked_marginals_are_those_of_single_texts(monkeypatch, chunk):
    """Blocks, cuts inside a text and neighbours change nothing, also where scores contradict each other."""
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    draw = np.random.default_rng(chunk)
    field = toxicity.Field()
    field.move = np.array([[1.3, -2.5], [-1.2, 0.9]])
    sizes = [3, 1, 0, 500, 2, 30_000 if chunk > 7 else 300, 17]
    texts = [draw.normal(-1, 6, n) for n in sizes]
    texts[3][100:110] = [40, -40] * 5
    got = toxicity.Model(field, [0.0] * 4).of_scores(texts)
    for scores, p in zip(texts, got):
        expected = field.marginals(scores[:, None], np.array([len(scores)]))[0][:, 0] if len(scores) else scores
        assert p.shape == expected.shape and np.allclose(p, expected, atol=1e-12)
    assert toxicity.Model(field, [0.0] * 4).of_scores([]) == []


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = ["a", "ab", "abc", "abcd", "abcdef", "abcdefg", "über", "word" * 20, "x" * 1000, "日本語", "xbcdefg"]
    together = toxicity.features(words)
    assert all((toxicity.features([w])[0] == f).all() for w, f in zip(words, together))
    # Equal beginnings and endings share features, different words do not.
    assert (together[4, 1:5] == together[5, 1:5]).all() and together[4, 0] != together[5, 0]
    assert (together[5, 5:] == together[10, 5:]).all() and len(set(together[:, 0].tolist())) == len(words)
    assert 0 <= together.min() and together.max() < 1 << toxicity.BITS and toxicity.features([]).shape == (0, 7)


def test_words_of_pieces_are_those_of_the_text():
    text = ("Wort für Wort, 12 " * 70_000 + "a" * 600_000 + "\n.") * 2
    pieces = toxicity.PIECE.findall(text)
    assert "".join(pieces) == text and [w for x in pieces for w in toxicity.WORD.findall(x)] == toxicity.WORD.findall(text)


def test_models_without_both_labels(odd_docs, no_docs, labels, spark):
    for rows in ([], [("a", 1)], [("a", 0), ("b", 0)]):
        model = toxicity.fit(rows)
        assert 0 <= model.score(np.zeros(0)) <= 1
    few = toxicity.score(odd_docs, "text", toxicity.learn(odd_docs, "doc_id", "text", labels)).collect()
    assert len(few) == odd_docs.count() and all(0 <= r.score <= 1 for r in few)
    for docs, known in ((odd_docs, labels), (odd_docs, labels.where("false")), (no_docs, labels)):
        model = quality_model.learn(docs, "doc_id", "text", known)
        rows = quality_model.score(docs, "text", model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_long_texts_end_no_sample(spark):
    """Each label has its own bytes, and what does not fit is passed over."""
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id long, y int")
    first = [r.doc_id for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    long = {first[0], first[5], *[i for i in first if i % 4 == 0][:1]}
    texts = {i: "w" * 5000 if i in long else f"text {i:04d}" for i in ids}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    short = [(texts[i], int(i % 4 == 0)) for i in first if i not in long]
    assert sample(docs, "doc_id", "text", known, "y", 4000, 4000) == short
    # Ten short texts of each label, and neither label takes the bytes of the other.
    got = sample(docs, "doc_id", "text", known, "y", 4000, 95)
    assert sorted(got) == sorted(r for y in (0, 1) for r in [x for x in short if x[1] == y][:10])
    # Repeated rows of one id count as rows of its label alone.
    more = docs.union(docs.where(F.col("doc_id") == next(i for i in first if i % 4 and i not in long)).crossJoin(spark.range(50)).select("doc_id", "text"))
    assert sum(y for _, y in sample(more, "doc_id", "text", known, "y", 20, 4000)) == 20
    assert sample(docs, "doc_id", "text", known, "y", 4000, 5) == []
    # Nor do long texts and labels without a text take the places of others.
    assert Counter(y for _, y in sample(docs, "doc_id", "text", known, "y", 7, 4000)) == {0: 7, 1: 7}


def test_context_sums_are_sums_over_pairs(spark):
    texts = ["a b c a", "b", None, "", "c c"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.kind: np.array(r[1:]) for r in quality_model.context_sums(docs, "text").collect()}
    places, signs = quality_model.index_vectors()
    expected = {}
    for t in texts:
        k = quality_model.kinds(t)
        for i in range(len(k)):
            for j in range(len(k)):
                if 0 < abs(i - j) <= 2:
                    expected.setdefault(k[i], np.zeros(quality_model.SIZE))[places[k[j]]] += signs[k[j]]
    expected = {k: v for k, v in expected.items() if v.any()}
    assert {k: v.tolist() for k, v in got.items()} == {int(k): v.tolist() for k, v in expected.items()}


@pytest.mark.parametrize("label,name", [("toxic", "op7_toxicity"), ("quality", "op10_quality_model")])
def test_held_out_accuracy(spark, label, name):
    from tidegauge.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, sf).collect() if r.held_out and known.get(r.doc_id) is not None]
    pos, neg = ([r.score for r in rows if known[r.doc_id] == y] for y in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.9


def plain_places(text):
    low = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def shortest(regex):
    """A text that a rule's regex matches: optional parts left out, the first of each choice."""
    while "(?:" in regex:
        regex = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] else m[1].split("|")[0], regex)
    return re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r".\?", "", regex))


def test_keywords_are_words_of_their_own_rules():
    for keyword, _, label, regex in licenses.rule_table():
        text = " ".join(shortest(regex).split())
        assert re.fullmatch(regex, text), (regex, text)
        assert keyword in text.split(), (keyword, label, text)


def plain_detections(w):
    """All rules at all words; then what a detection of no lower priority contains goes."""
    line, found = " ".join(w), []
    begins = np.cumsum([0, *(len(x) + 1 for x in w)])
    for keyword, priority, label, regex in licenses.rule_table():
        if keyword in w:
            for i in range(len(w)):
                m = re.compile(f"(?:{regex})(?= |$)").match(line, int(begins[i]))
                if m:
                    found.append((i, i + len(m[0].split()), priority, label))
    found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
    return [d for k, d in enumerate(found) if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] for e in found[:k])]


def test_licenses(spark, odd_docs, no_docs):
    texts = [
        "MIT License. mit license, Apache license; cc-by 4.0 CC BY-NC-SA 4.0 International", "GNU General Public License", None, "",
        "Licensed under the Apache License, Version 2.0 (the License); GNU General Public License version 3 or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only\nSPDX-License-Identifier: BSD-3-Clause", "gnu gnu general public license license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "cc by cc by cc by", "mİt license K mit license",
        "All rights reserved. Mozilla Public License 2.0 MPL 2.0 public domain",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(docs, "text").collect() + licenses.scan(odd_docs, "text").collect():
        w, places = plain_places(r.text)
        assert r.n_words == len(w) and sorted((p.start, p.label) for p in r.places) == places
        assert [(d.start, d.end, d.priority, d.label) for d in r.detections] == plain_detections(w)
        assert 0 <= r.score <= 1
    assert licenses.scan(no_docs, "text").collect() == []
    plan = licenses.scan(docs, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_archives(spark, tmp_path):
    big = "é" * 50_000
    pages = [(1, "u", big), (2, None, big), (3, "a b\r\nX: y", None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\n"), (None, "u", "x"), (None, "u", big), (6, "u", "x" * warc.CHUNK)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"sha1": F.lit(1), "first": F.lit(2)})
    chunks = warc.archived(df, "page_id", "url", "html", f"file://{tmp_path}/a").collect()
    ends = [r for r in chunks if r.last]
    assert len(ends) == len(pages)
    for page, _, html in pages:
        payload = (html or "").encode()
        same = [i for i, _, h in pages if (h or "") == (html or "") and i is not None]
        first = min(same) if same else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = first is not None and first != page
        assert [r for r in ends if (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (page, len(payload), digest, "revisit" if revisit else "response", first if revisit else None)]
        if not revisit and page is not None:
            own = sorted((r for r in chunks if r.page_id == page), key=lambda r: r.chunk_no)
            assert b"".join(bytes(r.data) for r in own) == payload and all(len(r.data) <= warc.CHUNK for r in own)
            done = b""
            for r in own:
                done += bytes(r.data)
                assert r.payload_digest == base64.b32encode(hashlib.sha1(done).digest()).decode()
    # Any reader of gzip members can read them.
    whole = b"".join(gzip.open(f).read() for f in (tmp_path / "a").glob("*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages)
    # Below the least size nothing is a revisit; no pages, no records.
    assert {r.record_type for r in warc.archived(df, "page_id", "url", "html", f"file://{tmp_path}/b", least=10**6).collect()} == {"response"}
    assert warc.archived(df.where("false"), "page_id", "url", "html", f"file://{tmp_path}/c").collect() == []


@pytest.mark.parametrize("page,text", [
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>x", "- a\n- b\n  - c\n- d\n\nx"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>5<tr><td colspan=2>wide<tr><td rowspan=2>r<td>1<tr><td>2</table>z", "Name    N\nlonger  5\nwide\nr       1\n        2\n\nz"),
    ("<p>one<p>two<div>three</div><i hidden>no</i><b style='color:red; display: none'>no</b> four", "one\n\ntwo\n\nthree\nfour"),
    ("<style>.x{display:none} q, i{visibility:hidden}</style><p class='a x'>no<p>y<i>no</i>es", "yes"),
    ("<pre>  a\n   b\n</pre>c<br><br>d", "  a\n   b\n\nc\n\nd"), ("<details><summary>S</summary>no</details>", "S"),
    ("a<!-- c -->b &amp; &lt;c&gt; 1 < 2</nothing>", "ab & <c> 1 < 2"), ("<title>t</title>x<script>no</script>", "x"), ("<a href='x", ""), (None, ""), ("", ""),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>o</table>", "in ner  o"), ("<dl><dt>T<dd>D</dl>", "T\n    D"),
])
def test_page_texts(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<style>@media print{ .no-print, nav {display:none}} @media (max-width:600px){.s{display:none}} @supports (x:y){b{display:none}}.h{display:none}</style><nav>n</nav><p class=no-print>p<p class=s>s<p class=h>no<p><b>b</b>", "n\n\np\n\ns\n\nb"),
    ("<style>@import 'x.css'; @media screen { .a{color:red;display:none} } @media screen and (max-width:9px){.b{display:none}} @media print, all{.c{display:none}}</style><i class=a>no</i><i class=b>b</i><i class=c>no</i>", "b"),
    ("<style media=print>p{display:none}</style><style>/* } */ .q::before{content:'}'} .r{&:hover{display:none}} .t{display:none;&:hover{color:red}}</style><p>p<p class=r>r<p class=t>no", "p\n\nr"),
    ("<style>@media print{.a{display:none}</style><noscript><style>.b{display:none}</style></noscript><i class=a>a</i><i class=b>b</i>", "ab"),
    ("so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2 TeX</annotation></semantics></math> holds", "so x=2 holds"),
    ("a<svg><title/><defs><text>no</text></defs><desc>no</desc><path d='M0'/><text>Jan</text><g/><text>Feb <tspan>12</tspan></text></svg>b", "a\nJan\nFeb 12\nb"),
    ("<svg><path><p>after</p>x", "after\n\nx"), ("<svg><foreignObject><div>in</div><p>deep</foreignObject></svg>", "in\n\ndeep"),
    ("a<xmp>  <b>x</b>\n    y &amp;</xmp>z", "a\n\n  <b>x</b>\n    y &amp;\n\nz"),
])
def test_pages_show_what_a_screen_shows(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<table><tr><td>a<br>bcd<td>e<tr><td>f<td>g<br>h</table>", "a    e\nbcd\nf    g\n     h"),
    ("<table><tr><td>1<td><pre>def f():\n    return  1\n\nf()</pre><td>2</table>z", "1\n\ndef f():\n    return  1\n\nf()\n\n   2\n\nz"),
    ("<table><tr><td>a<td><pre>x   y</pre></table>", "a  x   y"),
    ("<table><tr><td><ul><li>a<li>b<ul><li>c</ul></ul><td><p>one<p>two</table>", "- a\n- b\n  - c\n\none\n\ntwo"),
    ("<table><tr><td>l<td><table><tr><td>in<td>1<tr><td>ner<td>2</table><tr><td>m<td>n</table>", "l\n\nin   1\nner  2\n\nm  n"),
    ("<table><caption>A<br>B</caption><tr><td>c</table>", "A\nB\nc"),
    (f"<table><tr><td>{'x' * 50}<br>y<td>z</table>", f"{'x' * 50}\ny\n\nz"),
    ("<table><tr><td><p>k</p><td><div>5</div><tr><td>longer<td>6</table>", "k       5\nlonger  6"),
])
def test_cells_keep_their_lines(page, text):
    assert html_text.visible_text(page) == text


def test_tall_cells_take_linear_room():
    page = "<table><tr>" + "<td>x" * 20_000 + "<td>" + "y<br>" * 20_000
    assert len(html_text.visible_text(page)) < 5 * len(page)


def test_deep_and_broken_pages_take_linear_time():
    for page in ("<div>" * 50_000 + "x", "<a b='" * 30_000, "<li>" * 30_000, "</b>" * 30_000, "<!--" * 30_000, "<td colspan=999999999 rowspan=99999999>" * 300):
        html_text.visible_text(page)


def test_all_visible_words_of_all_pages(spark):
    """Brute force: what is left when hidden elements and tags are cut out, word by word."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract(pages, "html").collect():
        plain = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", r.html)
        plain = re.sub(r"</?(?:b|i|a|em|span|strong)\b[^>]*>", "", plain)
        expected = html.unescape(re.sub(r"</?[a-zA-Z!][^>]*>", " ", plain)).split()
        assert [w for w in r.text.split() if w != "-"] == [w for w in expected if w != "-"]
