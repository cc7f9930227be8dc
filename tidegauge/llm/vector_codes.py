"""Vector codes by product quantisation; nearest entries are searched in a GNAT.

Vectors become integers and are cut into equal parts; each part has a codebook that is
moved to the means of its parts for some rounds. Of each codebook a geometric near-
neighbour access tree is built: a node has split points, every other entry hangs on
its nearest split point, and the node stores, of every split point, the range of
distances to all entries of every child. A query computes its distance to a split
point and drops each child whose range lies wholly outside the ball of the best
distance so far. Ranges are stored a little wider, and the ball is a little larger, than
rounding could make them, and a child is dropped only when it is strictly farther, so no
nearer and no equally near entry is lost; entries are compared by exact integer
squared distance, then by index.

A round is one scan with partial sums per task (parts x entries x components); what
reaches the driver has the size of the codebooks.

Rows with a null vector or a null, NaN or infinite component are left out, and so are
rows whose vector is not as long as that of the smallest id, or empty. Repeated rows and
ids are rows like any other; rows with equal ids are ordered by their components, null
ids come last. An empty table gives no rows; fewer rows than entries give shorter
codebooks. Components of 2**27 and more after scaling are an error. Other columns of
the table, whatever their names, stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.rows import columns, map_arrow, staged, to_arrow
from tidegauge.llm.vectors import integers, scaled, totals, whole

#: Split points of a node, and how much wider than computed ranges and balls are.
DEGREE, SLACK = 4, 2.0**-40
HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), "S2")
BATCH = 1 << 13


class Node:
    """Split points of some entries, ranges to each child, and the children."""

    def __init__(self, book: np.ndarray, members: list[int]):
        self.splits = self.spread(book, members)
        groups: list[list[int]] = [[] for _ in self.splits]
        points = book[self.splits]
        for e in (e for e in members if e not in set(self.splits)):
            groups[int(((points - book[e]) ** 2).sum(axis=1).argmin())].append(e)
        self.points = points
        far = [[np.sqrt(((book[[s, *g]] - p) ** 2).sum(axis=1)) for s, g in zip(self.splits, groups)] for p in points]
        self.low = np.array([[d.min() * (1 - SLACK) for d in row] for row in far])
        self.high = np.array([[d.max() * (1 + SLACK) for d in row] for row in far])
        self.children = [Node(book, g) if g else None for g in groups]

    @staticmethod
    def spread(book: np.ndarray, members: list[int]) -> list[int]:
        """Up to DEGREE entries, each as far as can be from those before it."""
        if len(members) <= DEGREE:
            return list(members)
        chosen = [members[0]]
        near = ((book[members] - book[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < DEGREE:
            # A chosen entry is marked, so that it is not taken again among equal ones.
            near[members.index(chosen[-1])] = -1
            chosen.append(members[int(near.argmax())])
            near = np.where(near < 0, near, np.minimum(near, ((book[members] - book[chosen[-1]]) ** 2).sum(axis=1)))
        return chosen

    def search(self, rows: np.ndarray, x: np.ndarray, best: np.ndarray, who: np.ndarray) -> int:
        """Improve ``best`` (squared distance) and ``who`` (entry) of some rows of ``x``; counts distances."""
        alive = np.ones((len(rows), len(self.splits)), bool)
        computed = 0
        for i, entry in enumerate(self.splits):
            at = np.flatnonzero(alive[:, i])
            own = rows[at]
            d = ((x[own] - self.points[i]) ** 2).sum(axis=1)
            computed += len(own)
            better = (d < best[own]) | ((d == best[own]) & (entry < who[own]))
            best[own[better]], who[own[better]] = d[better], entry
            far, ball = np.sqrt(d), np.sqrt(best[own])
            slack = (far + ball) * SLACK
            outer, inner = far + ball + slack, far - ball - slack
            alive[at] &= ~((self.low[i] > outer[:, None]) | (self.high[i] < inner[:, None]))
        for j, child in enumerate(self.children):
            if child is not None and (at := np.flatnonzero(alive[:, j])).size:
                computed += child.search(rows[at], x, best, who)
        return computed


class Codebook:
    """Entries of one part (an integer matrix) and their tree."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.tree = Node(entries, list(range(len(entries))))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row; ties go to the lower index."""
        best, who = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))
        self.tree.search(np.arange(len(x)), x, best, who)
        return who, best


def parts_of(ints: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(ints, parts, axis=1)


def first(vectors: DataFrame, entries: int, parts: int, scale: int) -> np.ndarray:
    """Integer vectors of the smallest ids; they give the dimension too."""
    finite = vectors.where(whole(F.col("v"), F.size("v")) & (F.size("v") > 0)).select("id", scaled(F.col("v"), scale).alias("v"))
    found = finite.orderBy(F.asc_nulls_last("id"), "v").limit(1).collect()
    if not found:
        return np.zeros((0, 0), np.int64)
    dim = len(found[0].v)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    found = finite.where(F.size("v") == dim).orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    return np.array([r.v for r in found], np.int64)


def sums(vectors: DataFrame, books: list[Codebook], scale: int) -> DataFrame:
    """Partial sums (part, entry, place, total) of the nearest parts; place -1 counts them."""
    k, wide = books[0].entries.shape
    dim = wide * len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(books), k, wide + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                _, ints = integers(batch.column("v").slice(at, BATCH), dim, scale)
                for p, x in enumerate(parts_of(ints, len(books))):
                    who, _ = books[p].nearest(x)
                    chosen = (who == np.arange(k)[:, None]).astype(np.int64)
                    out[p, :, :wide] += chosen @ x
                    out[p, :, wide] += chosen.sum(axis=1)
        p, e, place = np.indices(out.shape)
        used = np.broadcast_to(out[:, :, wide:] > 0, out.shape)
        place = np.where(place == wide, -1, place)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c[used], pa.int32()) for c in (p, e, place)), pa.array(out[used], pa.int64())],
            ["part", "entry", "place", "total"],
        )

    return map_arrow(vectors.select("v"), run, "part int, entry int, place int, total long")


def moved(books: list[Codebook], found: list) -> list[Codebook]:
    """Entries at the floor of their parts' means; unused ones stay."""
    of = {(r.part, r.entry, r.place): int(r.total) for r in found}
    new = [b.entries.copy() for b in books]
    for part, entry, place in of:
        if place >= 0:
            new[part][entry, place] = of[part, entry, place] // of[part, entry, -1]
    return [Codebook(e) for e in new]


def learn(vectors: DataFrame, vec_id: str, embedding: str, entries: int = 16, parts: int = 8, rounds: int = 6, scale: int = 4096) -> list[Codebook]:
    """A codebook per part; none if there is no vector."""
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    rows = columns(vectors, id=vec_id, v=embedding)
    start = first(rows, entries, parts, scale)
    if not len(start):
        return []
    books = [Codebook(e) for e in parts_of(start, parts)]
    for _ in range(rounds):
        books = moved(books, totals(sums(rows, books, scale), "part", "entry", "place"))
    return books


def encode(vectors: DataFrame, vec_id: str, embedding: str, label: str, books: list[Codebook], scale: int = 4096) -> DataFrame:
    """Id, label, ``code`` (two hexadecimal digits per part) and squared ``error`` of every vector."""
    rows = columns(vectors, id=vec_id, label=label, v=embedding)
    kinds = [rows.schema[c].dataType for c in ("id", "label")]
    schema = f"id {kinds[0].simpleString()}, label {kinds[1].simpleString()}, code string, error long"
    if not books:
        return vectors.sparkSession.createDataFrame([], schema)
    arrow = [to_arrow(k) for k in kinds]
    dim = books[0].entries.shape[1] * len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                places, ints = integers(part.column("v"), dim, scale)
                error, codes = np.zeros(len(ints), np.int64), []
                for book, x in zip(books, parts_of(ints, len(books))):
                    who, d = book.nearest(x)
                    error += d
                    codes.append(HEX[who])
                text = np.ascontiguousarray(np.stack(codes, axis=1)).view(f"S{2 * len(books)}").ravel().astype(str)
                own = [part.column(c).take(pa.array(places)).cast(t) for c, t in zip(("id", "label"), arrow)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(text.tolist(), pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return map_arrow(rows, run, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors summed over equal labels, nulls together.

    Sums are formed before rows meet, so a label that most rows have is one row per task.
    """
    rows = staged(coded, "codes")
    per_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return rows.join(per_label, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def decoded(codes: DataFrame, code: str, books: list[Codebook], scale: int = 4096, out: str = "vector") -> DataFrame:
    """``codes`` with the vector that the code stands for; null for a null code."""
    lists = [F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in b.entries]) for b in books]
    digits = [F.conv(F.substring(F.col(f"`{code}`"), 2 * i + 1, 2), 16, 10).cast("int") for i in range(len(books))]
    return codes.withColumn(out, F.transform(F.concat(*[F.get(x, d) for x, d in zip(lists, digits)]), lambda v: v / scale))


def text_of(books: list[Codebook]) -> str:
    """All components by part, entry and place, comma-joined."""
    return ",".join(str(v) for b in books for v in b.entries.ravel().tolist())
