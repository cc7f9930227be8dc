"""SimHash classes, components and suffix cuts against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidegauge.llm import simhash, suffix_dedup
from tidegauge.llm.components import components
from tidegauge.llm.difference_cover import COVER, MODULUS, repeated


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(values, threshold):
    """Smallest member number of each value's component, by all pairs."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            near = [j for j in range(len(values)) if bin(values[i] ^ values[j]).count("1") <= threshold]
            m = min(label[j] for j in near)
            for j in near:
                if label[j] != m:
                    label[j], changed = m, True
    return label


def test_every_link_meets_in_a_bucket(spark):
    rng = random.Random(4)
    values = []
    for _ in range(40):
        x = rng.getrandbits(64)
        values.append(x)
        for _ in range(4):
            x ^= sum({1 << b for b in rng.sample(range(64), rng.randrange(1, 6))})
            values.append(x)
    values = sorted(set(values))
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    for block in (4096, 2):
        edges = simhash.links(nodes, 4, block)
        found = {r.node: r.label for r in components(edges).collect()}
        got = [found.get(r, r) for r in (int(np.uint64(v).view(np.int64)) for v in values)]
        expected = classes_of(values, 4)
        assert len(set(zip(got, expected))) == len(set(got)) == len(set(expected))


def test_components_of_paths_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (300, 301), (301, 300), (301, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_classes_of_odd_rows(odd_docs, no_docs):
    rows = simhash.classes(odd_docs, "doc_id", "text").collect()
    assert len(rows) == odd_docs.count()
    prints = [plain_fingerprint(r.text) for r in rows]
    assert [r.fp & 2**64 - 1 for r in rows] == prints
    label = classes_of(prints, 4)
    for r, own in zip(rows, label):
        ids = [x.doc_id for x, other in zip(rows, label) if other == own and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.keep_one(odd_docs, "doc_id", "text")
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(set(label))
    assert simhash.keep_one(no_docs, "doc_id", "text").collect() == []


def plain_cut(texts, size=200):
    count = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append(bytes(b for b, g in zip(t, gone) if not g))
    return out


def test_difference_cover_is_one():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))


def test_repeated_starts_of_a_block():
    rng = random.Random(3)
    for _ in range(15):
        base = bytes(rng.choice(b"ab") for _ in range(600))
        texts = [b"", b"ab"]
        for _ in range(rng.randrange(1, 10)):
            a = rng.randrange(300)
            x = bytearray(base[a : a + rng.randrange(330)])
            for _ in range(rng.randrange(3)):
                if x:
                    x[rng.randrange(len(x))] = rng.choice(b"abc")
            texts.append(bytes(x))
        buckets = np.sort([rng.randrange(3) for _ in texts])
        count = Counter((b, t[i : i + 200]) for b, t in zip(buckets, texts) for i in range(len(t) - 199))
        assert [list(f) for f in repeated(texts, buckets)] == [[count[b, t[i : i + 200]] > 1 for i in range(max(0, len(t) - 199))] for b, t in zip(buckets, texts)]


@pytest.mark.parametrize("limit", [4096, 1])
def test_cuts_are_brute_force(spark, odd_docs, limit):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdé ") for _ in range(700))
    extra = [(100 + i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(300))) + passage[rng.randrange(200) : 400 + rng.randrange(300)] + str(i)) for i in range(12)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(extra + [(500, "pq" * 900), (501, passage[:150])], "doc_id long, text string"))
    texts = [(r.text or "").encode() for r in docs.collect()]
    expected = Counter(zip(texts, plain_cut(texts)))
    rows = suffix_dedup.keyed(docs, "text").join(suffix_dedup.per_text(docs, "text", bucket_limit=limit), ["t1", "t2"]).collect()
    assert Counter((bytes(r.data), bytes(r.kept)) for r in rows) == expected
    for r in rows:
        assert r.n_bytes == len(r.data) and r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)


def test_cut_documents_keeps_rows_columns_and_characters(odd_docs, no_docs):
    out = suffix_dedup.cut_documents(odd_docs, "text")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert out.where("text IS NULL").count() == odd_docs.where("text IS NULL").count()
    assert all("�" not in (r.text or "") for r in out.collect())
    assert suffix_dedup.cut_documents(no_docs, "text").collect() == []
    assert suffix_dedup.whole_characters("aéb".encode(), [[2, 4]]) == [[3, 4]]
    assert suffix_dedup.whole_characters("aéb".encode(), [[0, 2]]) == [[0, 1]]
