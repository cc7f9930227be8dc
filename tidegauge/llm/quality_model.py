"""Document quality from random-indexing word vectors and a small network.

Every token belongs to one of ``BUCKETS`` kinds (its shape and first letters, hashed).
Each kind has a sparse random index vector; the vector of a kind is the sum of the index
vectors of the tokens within two places of it, over the whole corpus: every task sums its
part, the parts are added up by kind. Vectors are scaled to length one and pooled per
document (mean and spread of its tokens). A two-layer network, trained in numpy on a
bounded labelled sample, gives a logit, whose temperature is set on a part of the sample
that the network has not seen.

The vectors and the network have fixed sizes and are broadcast. The fit uses at most
``PER_CLASS`` rows and ``MAX_BYTES`` of text per label; vectors use all texts, and whole
texts are scored. A null or empty text has a zero vector and the network's score for it.
With labels of one kind only, every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.labelled import held_out, sample
from tidegauge.llm.rows import columns, map_arrow, map_rows, slices

BUCKETS, SIZE, NONZERO = 8192, 32, 4
PER_CLASS, MAX_BYTES = 4000, 24 << 20
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|\n")
SEEN: dict[str, int] = {}


def kind(token: str) -> int:
    """The bucket of a token: shape, first letters and a class of length."""
    if token[0].isalpha():
        shape = "U" if len(token) > 1 and token.isupper() else "C" if token[0].isupper() else "l"
        token = f"{shape}{token[:4].lower()}{min(len(token), 12)}"
    else:
        token = token[:4]
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


def kinds(text: str | None) -> np.ndarray:
    tokens = TOKEN.findall(text) if text else []
    if len(SEEN) > 200_000:
        SEEN.clear()
    for t in set(tokens).difference(SEEN):
        SEEN[t] = kind(t)
    return np.fromiter(map(SEEN.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few parts of each kind's index vector."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((BUCKETS, SIZE)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def context_sums(docs: DataFrame, text: str) -> DataFrame:
    """(kind, v0 ... ): the sum of index vectors around each kind, over all texts."""
    names = [f"v{i}" for i in range(SIZE)]
    schema = "kind int, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * SIZE)
        for batch in batches:
            for part in slices(batch, "text"):
                # One stream of tokens; two blanks (kind -1) stand between texts.
                blank = np.full(2, -1)
                k = np.concatenate([x for t in part.column("text").to_pylist() for x in (kinds(t), blank)])
                for gap in (1, 2):
                    a, b = k[:-gap], k[gap:]
                    good = (a >= 0) & (b >= 0)
                    a, b = a[good], b[good]
                    for one, other in ((a, b), (b, a)):
                        for i in range(NONZERO):
                            total += np.bincount(one * SIZE + places[other, i], signs[other, i], BUCKETS * SIZE)
        table = total.reshape(BUCKETS, SIZE)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(table[used, i]) for i in range(SIZE))], ["kind", *names])

    parts = map_arrow(columns(docs, text=text), run, schema)
    return parts.groupBy("kind").agg(*[F.sum(n).alias(n) for n in names])


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """Unit vectors of all kinds, a table of fixed size."""
    out = np.zeros((BUCKETS, SIZE), np.float32)
    for row in context_sums(docs, text).toLocalIterator():
        v = np.array(row[1:])
        out[row[0]] = v / max(np.linalg.norm(v), 1e-9)
    return out


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the tokens' vectors, the mean's length, and the number of tokens."""
    out = np.zeros((len(texts), 2 * SIZE + 3), np.float32)
    for row, text in zip(out, texts):
        k = kinds(text)
        if not len(k):
            continue
        # Kinds with their counts: a text has far fewer kinds than tokens.
        some, n = np.unique(k, return_counts=True)
        v, w = vectors[some], (n / len(k)).astype(np.float32)
        mean = w @ v
        row[:SIZE], row[SIZE : 2 * SIZE] = mean, np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
        row[-3:] = np.linalg.norm(mean), math.log1p(len(k)) / 10, len(some) / len(k)
    return out


class Network:
    """Two layers over scaled inputs; ``temperature`` divides the logit, ``shift`` adds the prior's odds."""

    def __init__(self, inputs: int, hidden: int = 32):
        rng = np.random.default_rng(5)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.parts = [rng.normal(0, 1 / math.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
        self.temperature, self.shift = 1.0, 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 3e-3, decay: float = 1e-3) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng, first, second, step = np.random.default_rng(6), [0.0] * 4, [0.0] * 4, 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for k in range(0, len(order), 128):
                own = order[k : k + 128]
                a, b, c, d = self.parts
                z = (x[own] - self.mean) / self.scale
                h = np.tanh(z @ a + b)
                e = (1 / (1 + np.exp(-np.clip(h @ c + d, -30, 30))) - y[own]) / len(own)
                back = e[:, None] * c * (1 - h * h)
                step += 1
                for i, g in enumerate((z.T @ back + decay * a, back.sum(axis=0), h.T @ e + decay * c, e.sum(keepdims=True))):
                    first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                    self.parts[i] = self.parts[i] - rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the smallest log loss on rows that were not trained on."""
        z = self.logits(x)
        grid = np.exp(np.linspace(math.log(0.3), math.log(10), 200))
        loss = [np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -30, 30)))


def fit(rows: list[tuple[str, int]], vectors: np.ndarray, share: float) -> Network:
    """A network from (text, label) rows; ``share`` is the share of label 1 among all labelled rows."""
    y = np.array([label for _, label in rows], float)
    x = pooled([t for t, _ in rows], vectors)
    net = Network(2 * SIZE + 3)
    unseen = np.random.default_rng(8).random(len(y)) < 0.2
    if len(set(y[~unseen])) < 2:
        net.parts = [np.zeros_like(p) for p in net.parts]
        net.shift = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return net
    net.train(x[~unseen], y[~unseen])
    if len(set(y[unseen])) == 2:
        net.calibrate(x[unseen], y[unseen])
    mean = y.mean()
    if 0 < share < 1:
        net.shift = math.log(share / (1 - share)) - math.log(mean / (1 - mean))
    return net


def learn(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs, text)
    share = columns(labels, id="doc_id", y=label).where(F.col("y").isin(0, 1) & ~held_out(F.col("id"))).agg(F.avg("y")).first()[0]
    return vectors, fit(sample(docs, doc_id, text, labels, label, per_class, max_bytes), vectors, share or 0.0)


def score(docs: DataFrame, text: str, model: tuple[np.ndarray, Network], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a calibrated ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str | None]) -> list:
        vectors, net = shared.value
        return [net.scores(pooled(texts, vectors)).astype(float).tolist() if texts else []]

    return map_rows(docs, text, T.StructType([T.StructField("score", T.DoubleType())]), make, keep)
