"""Vector codes, centroids and source mixing against brute-force versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegauge.llm import centroids, queries, source_mix, vector_codes

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, code string, cluster string, total string"


def odd_vectors(spark, dim):
    """Ties, repeated rows and ids, null ids and labels, and every kind of row that is left out."""
    draw = random.Random(5)
    rows = []
    for i in range(90):
        rows.append((draw.choice([i, i, i, 7]), [draw.randint(-3, 3) / 64 for _ in range(dim)], draw.choice([0, 0, 0, 1, None])))
    rows += [rows[3]] * 30 + [(None, [0.5] * dim, None), (None, [0.5] * dim, None)]
    rows += [(200, None, 1), (201, [None] * dim, 1), (202, [NAN] + [0.0] * (dim - 1), 1), (203, [INF] + [0.0] * (dim - 1), None)]
    rows += [(204, [-INF] * dim, 1), (205, [0.1] * (dim - 8), 1), (206, [0.1] * (dim + 8), 1), (207, [], 1), (None, None, None)]
    return spark.createDataFrame([(*r, "x", "y", "z", "c", "t") for r in rows], SCHEMA)


def kept(rows, dim, scale):
    """(id, integers, label) of the rows that count, of single-precision components."""
    out = []
    for r in rows:
        if r.embedding is not None and len(r.embedding) == dim and all(x is not None and math.isfinite(x) for x in r.embedding):
            out.append((r.vec_id, [math.floor(scale * x) for x in r.embedding], r.label))
    return out


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(points, book, rounds):
    def nearest(p):
        return min(range(len(book)), key=lambda c: (far(p, book[c]), c))

    for _ in range(rounds):
        own = defaultdict(list)
        for p in points:
            own[nearest(p)].append(p)
        book = [[sum(x) // len(own[c]) for x in zip(*own[c])] if c in own else book[c] for c in range(len(book))]
    return book, [nearest(p) for p in points]


def of_text(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run_query(spark, name, df, table, tmp_path):
    df.write.parquet(f"{tmp_path}/{table}.parquet")
    return queries.QUERIES[name](spark, str(tmp_path)).collect()


def test_codes_are_brute_force(spark, tmp_path):
    df = odd_vectors(spark, 16)
    rows = kept(df.collect(), 16, 4096)
    start = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    codes, errors, text = [""] * len(rows), [0] * len(rows), []
    for q in range(8):
        own = slice(2 * q, 2 * q + 2)
        points = [r[1][own] for r in rows]
        book, who = lloyd(points, [r[1][own] for r in start], 6)
        text += [str(x) for e in book for x in e]
        for i, (p, c) in enumerate(zip(points, who)):
            codes[i] += f"{c:02x}"
            errors[i] += far(p, book[c])
    per_label = Counter()
    for r, e in zip(rows, errors):
        per_label[r[2]] += e
    digest = of_text(",".join(text))
    expected = Counter((r[0], c, e, per_label[r[2]], digest) for r, c, e in zip(rows, codes, errors))
    assert Counter(map(tuple, run_query(spark, "op11_vector_codes", df, "embeddings", tmp_path))) == expected


def test_centroids_are_brute_force(spark, tmp_path):
    df = odd_vectors(spark, 64)
    rows = kept(df.collect(), 64, 256)
    start = sorted(rows, key=lambda r: (r[0] is None, of_text(f"2:{r[0]}"), r[1]))[:40]
    points = [r[1] for r in rows]
    book, who = lloyd(points, [r[1] for r in start], 5)
    inertia = Counter()
    for p, c in zip(points, who):
        inertia[c] += far(p, book[c])
    total = sum(inertia.values())
    expected = Counter((r[0], c, far(r[1], book[c]), inertia[c], total, of_text(",".join(map(str, book[c])))) for r, c in zip(rows, who))
    assert Counter(map(tuple, run_query(spark, "op13_centroids", df, "embeddings", tmp_path))) == expected


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_centroids"])
def test_no_vectors_give_no_rows(spark, tmp_path, name):
    assert run_query(spark, name, odd_vectors(spark, 64).where("vec_id between 200 and 204"), "embeddings", tmp_path) == []


@pytest.mark.parametrize("k,spread", [(1, 3), (5, 1), (16, 2), (16, 400), (100, 6), (256, 10**7)])
def test_tree_finds_the_nearest_entry_and_the_lower_of_ties(k, spread):
    draw = np.random.default_rng(k)
    book, x = draw.integers(-spread, spread + 1, (k, 4)), draw.integers(-spread, spread + 1, (700, 4))
    distance = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    who, best = vector_codes.Codebook(book).nearest(x)
    assert (who == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def test_tree_drops_whole_subtrees():
    draw = np.random.default_rng(1)
    book = np.concatenate([draw.integers(-50, 50, (40, 4)) + c for c in (0, 5000, -7000, 20000)])
    x = np.concatenate([draw.integers(-50, 50, (100, 4)) + c for c in (0, 5000, -7000, 20000)])
    best, who = np.full(400, 2**62), np.full(400, 160)
    assert vector_codes.Codebook(book).tree.search(np.arange(400), x, best, who) < 400 * 160 / 3


def test_codes_decode_to_their_entries(spark):
    books = [vector_codes.Codebook(np.array([[0, 4096], [8192, -4096]])), vector_codes.Codebook(np.array([[1, 2], [3, 4]]))]
    rows = vector_codes.decoded(spark.createDataFrame([("0100",), ("0001",), (None,)], "code string"), "code", books).collect()
    assert [r.vector for r in rows] == [[2.0, -1.0, 1 / 4096, 2 / 4096], [0.0, 1.0, 3 / 4096, 4 / 4096], None]


def test_dictionaries_are_lossless():
    block = np.random.default_rng(3).integers(-9, 9, (500, 3))
    entries, codes = centroids.distinct(block)
    assert (entries[codes] == block).all() and len({tuple(e) for e in entries.tolist()}) == len(entries)


def plain_targets(sizes, weights=(5, 2, 1)):
    """Shares by weight, what is over a source's limit shared again, one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * rate for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def mix_docs(spark, n=900):
    draw = random.Random(2)
    rows = []
    for i in range(n):
        size = int(draw.choice([0, 1, 5, 40, 40, 40, draw.random() ** 3 * 900]))
        rows.append((i, " \t".join(["w"] * size) or draw.choice(["", None, " \n"]), draw.choice(["a", "b", "c", "d", "ü", "Z", "a\U0001f642", None])))
    # One document that a third of all rows repeat, ids without a value, the last code points of all.
    rows += [(5000, "seven words in a row, that is", "a")] * (n // 2) + [(None, "x y", "b")] * 3 + [(None, None, None)]
    return spark.createDataFrame([(*r, 1, "q", 2.0) for r in rows], "doc_id long, text string, source string, size int, target string, p double")


@pytest.mark.parametrize("block", [16, 2000])
def test_mix_meets_targets_and_repeats(spark, block):
    docs = mix_docs(spark)
    got = source_mix.expanded(source_mix.plan(docs, "doc_id", "text", "source", block=block)).collect()
    assert Counter((r.id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, len((r.text or "").split())) for r in docs.collect())
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    expected = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
    for s in sizes:
        # A few hundred documents in eight sources: within 0.4 % of each target.
        assert abs(taken[s] - expected[s]) <= 0.004 * expected[s], s
    again = source_mix.expanded(source_mix.plan(docs.repartition(7, "text"), "doc_id", "text", "source", block=block)).collect()
    assert Counter((r.id, r.source, r.taken) for r in got) == Counter((r.id, r.source, r.taken) for r in again)


def test_mix_is_written_out_as_planned(spark):
    docs = mix_docs(spark, 60)
    planned = source_mix.plan(docs, "doc_id", "text", "source")
    rows = source_mix.mixed(docs, planned, "doc_id", "text", "source").collect()
    assert sum(len((r.text or "").split()) for r in rows) == sum(r.taken for r in source_mix.expanded(planned).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "a")], [(1, "one", "a")]])
def test_mix_of_few_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = run_query(spark, "op12_source_mix", docs, "documents", tmp_path)
    assert len(got) == len(rows)
    assert all(r.target == (1.5 if r["size"] else 0.0) and r.taken in (0, r["size"], 2 * r["size"]) for r in got)


def test_flight_keeps_totals_and_chances():
    draw = random.Random(4)
    x = sorted((draw.randint(1, 500) for _ in range(40)), reverse=True)
    start = [draw.random() for _ in x]
    mean = [0.0] * len(x)
    for _ in range(3000):
        p = list(start)
        left = source_mix.fly(p, x, [draw.random() for _ in x])
        assert len(left) <= 2 and all(v in (0.0, 1.0) for i, v in enumerate(p) if i not in left)
        assert sum(p) == pytest.approx(sum(start), abs=1e-6)
        assert sum(a * b for a, b in zip(p, x)) == pytest.approx(sum(a * b for a, b in zip(start, x)), abs=1e-3)
        mean = [m + v / 3000 for m, v in zip(mean, p)]
    assert max(abs(m - s) for m, s in zip(mean, start)) < 0.05


def test_landing_takes_the_nearest_outcome():
    p, x = [0.5, 0.25, 0.75, 0.5], [9.0, 4.0, 4.0, 1.0]
    source_mix.land(p, x, [0, 1, 2, 3])
    assert p == [1.0, 0.0, 0.0, 0.0] or sum(a * b for a, b in zip(p, x)) == 9.0
