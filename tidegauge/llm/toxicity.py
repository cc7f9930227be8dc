"""Toxic spans by a linear-chain conditional random field over words.

Labels say which documents are toxic, not which words. Words are labelled from them:
a word is toxic if it stands in a toxic document and it, or its beginning of five or
more letters, is found in toxic documents at ``odds`` times the rate of the others.
The field has two states, hashed features of the word itself (the word, beginnings,
endings) and transitions; it is trained on whole texts by gradient steps over forward-
backward marginals. A document's score comes from its marginals (expected number of
toxic words, their share, the largest one) by a logistic function fitted on the same
rows, and shifted from the sample's share of toxic rows to that of all learnable labels,
so that a score means the same at every size. Spans are runs of words whose marginal is over one half, as character offsets.

The fit uses at most ``PER_CLASS`` labelled rows and ``MAX_BYTES`` of text per label (the
model has a fixed size and is broadcast); every text is scored whole.

Null and empty texts, and texts without a letter, have no spans and the score of no
evidence. Where there are no labelled rows of both kinds, every score is the share of
toxic ones among the learnable labels (0 if there are none).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.labelled import held_out, sample
from tidegauge.llm.rows import columns, map_rows

PER_CLASS, MAX_BYTES = 4000, 14 << 20
BITS = 18
#: Longest sequence of one training step; neighbours of a cut do not see each other.
STEP = 256
#: Words whose marginals are computed side by side, and words whose scores a task remembers.
CHUNK, KNOWN = 1 << 15, 50_000
SHORT, MIX = 24, np.uint64(0xD6E8FEB86659FD93)
WORD = re.compile(r"[^\W\d_]+")
#: A long text in pieces that end with a word or between words.
PIECE = re.compile(r"(?s).{1,500000}[^\W\d_]*")
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def beginnings(word: str) -> list[str]:
    return [word, *(word[:n] + "+" for n in range(5, min(9, len(word)) + 1))]


def features(words: list[str]) -> np.ndarray:
    """Hashed features of words, seven each, of which short words repeat some.

    They are the word, its beginnings of 3 to 6 letters and its endings of 3 and 4. Words are
    hashed side by side, letter by letter; of the few very long ones the edges are.
    """
    out = np.empty((len(words), 7), np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for least, most in ((0, SHORT), (SHORT, 16 * SHORT)):
        own = np.flatnonzero((sizes > least) & (sizes <= most))
        if len(own):
            out[own] = _side_by_side([words[i] for i in own.tolist()], sizes[own])
    for i in np.flatnonzero(sizes > 16 * SHORT).tolist():
        head, tail = words[i][:6], words[i][-4:]
        edges = _side_by_side([head, tail], np.array([6, 4]))
        out[i] = [zlib.crc32(words[i].encode("utf-8", "surrogatepass")), *edges[0, 1:5], *edges[1, 5:]]
    return ((out ^ (out >> np.uint64(29))) * MIX >> np.uint64(64 - BITS)).astype(np.int32)


def _side_by_side(words: list[str], n: np.ndarray) -> np.ndarray:
    """Hashes of the seven parts of words of about one length; n are their lengths."""
    out = np.empty((len(words), 7), np.uint64)
    letters = np.array(words, f"U{n.max()}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(max(6, letters.shape[1])):
        if k < letters.shape[1]:
            h = np.where(k < n, (h ^ letters[:, k]) * MIX, h)
        if 2 <= k <= 5:
            out[:, k - 1] = h ^ np.uint64(k)
    out[:, 0] = h ^ np.uint64(9)
    h = np.full(len(words), 0xC2B2AE3D27D4EB4F, np.uint64)
    for k in range(4):
        h = np.where(k < n, (h ^ letters[np.arange(len(words)), np.maximum(n - 1 - k, 0)]) * MIX, h)
        if k >= 2:
            out[:, k + 3] = h ^ np.uint64(k)
    return out


def toxic_forms(texts: list[list[str]], labels: list[int], odds: float = 12.0, least: int = 4) -> set[str]:
    """Words and beginnings that are far more frequent in toxic documents."""
    toxic = Counter()
    for words, y in zip(texts, labels):
        if y:
            toxic.update({form for w in set(words) for form in beginnings(w)})
    toxic = {form: n for form, n in toxic.items() if n >= least}
    # Of the others only the forms that could be chosen are counted.
    clean = Counter()
    for words, y in zip(texts, labels):
        if not y:
            clean.update({form for w in set(words) for form in beginnings(w)}.intersection(toxic))
    n0, n1 = labels.count(0), labels.count(1)
    return {form for form, n in toxic.items() if (n / n1) > odds * ((clean[form] + 0.5) / n0)}


class Field:
    """Weights of the field: ``w`` per hashed feature for the toxic state, transitions, start."""

    def __init__(self):
        self.w = np.zeros(1 << BITS, np.float32)
        self.move = np.zeros((2, 2))

    def emissions(self, words: list[str], known: dict[str, float]) -> np.ndarray:
        """Scores of words; ``known`` remembers a bounded number of them for its owner."""
        if len(known) > KNOWN:
            known.clear()
        new = list(set(words).difference(known))
        known.update(zip(new, self.w[features(new)].sum(axis=1, dtype=np.float64).tolist()))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sequences (columns, padded below): P(toxic) per place, and expected moves.

        Scores are log weights of the toxic state; the other state has 0.
        """
        steps, n = scores.shape
        m = np.exp(self.move)
        e = np.exp(np.clip(scores, -30, 30))
        here = np.arange(steps)[:, None] < sizes
        fore = np.empty((steps, 2, n))
        back = np.ones((steps, 2, n))
        now = np.stack([np.ones(n), e[0]])
        fore[0] = now / now.sum(axis=0)
        for t in range(1, steps):
            a, b = fore[t - 1]
            x, y = a * m[0, 0] + b * m[1, 0], (a * m[0, 1] + b * m[1, 1]) * e[t]
            s = x + y
            fore[t, 0], fore[t, 1] = x / s, y / s
        for t in range(steps - 2, -1, -1):
            a, b = back[t + 1, 0], back[t + 1, 1] * e[t + 1]
            x, y = m[0, 0] * a + m[0, 1] * b, m[1, 0] * a + m[1, 1] * b
            s = x + y
            inside = here[t + 1]
            back[t, 0], back[t, 1] = np.where(inside, x / s, 1.0), np.where(inside, y / s, 1.0)
        both = fore * back
        p = both[:, 1] / both.sum(axis=1)
        moves = np.zeros((2, 2))
        if steps > 1:
            pair = fore[:-1, :, None] * m[None, :, :, None] * (back[1:] * np.stack([np.ones_like(e[1:]), e[1:]], 1))[:, None]
            pair *= here[1:, None, None] / pair.sum(axis=(1, 2), keepdims=True)
            moves = pair.sum(axis=(0, 3))
        return np.where(here, p, 0.0), moves

    def whole_marginals(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(toxic) of every word of texts set end to end; ``starts`` are the places of first words.

        The same sums as in ``marginals``, of any length at one price: what leads over a
        text's first word forgets the state before it, so all texts are one chain, which is
        cut into blocks. The products of the blocks' 2 x 2 steps are formed side by side,
        block products are chained, and the states at the blocks' edges give those inside.
        """
        first = np.zeros(len(scores), bool)
        first[starts] = True
        # Cuts lie between texts where they can; only then no state is handed on.
        cuts = [0]
        while len(scores) - cuts[-1] > CHUNK:
            last = np.searchsorted(starts, cuts[-1] + CHUNK, "right") - 1
            cuts.append(int(starts[last]) if starts[last] > cuts[-1] else cuts[-1] + CHUNK)
        parts = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(scores)])]
        into, out_of = [np.ones(2)] * len(parts), [np.ones(2)] * len(parts)
        if not first[cuts[1:]].all():
            chunks = [product(prefixes(self.steps(scores[k], first[k]))[-1]) for k in parts]
            for k in range(1, len(parts)):
                into[k] = unit(into[k - 1] @ chunks[k - 1])
            for k in range(len(parts) - 2, -1, -1):
                out_of[k] = unit(chunks[k + 1] @ out_of[k + 1])
        found = [filled(self.steps(scores[k], first[k]), a, b)[: k.stop - k.start] for k, a, b in zip(parts, into, out_of) if k.stop > k.start]
        return np.concatenate(found) if found else np.zeros(0)

    def steps(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The steps into each word, [place in block, state before, state, block]."""
        length = max(8, int(len(scores) ** 0.5) // 2)
        blocks = -(-len(scores) // length)

        def dealt(x: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(np.pad(x, (0, length * blocks - len(x))).reshape(blocks, length).T)

        odds = dealt(np.exp(np.clip(scores, -30, 30)))
        clean = 1 / (1 + odds)
        here, anew = (clean, odds * clean), dealt(first)
        m = np.exp(self.move - self.move.max())
        out = np.empty((length, 2, 2, blocks))
        for i in (0, 1):
            for j in (0, 1):
                np.multiply(np.where(anew, 1.0, m[i, j]), here[j], out=out[:, i, j])
        # Places behind the last word change nothing.
        out[length - (length * blocks - len(scores)) :, :, :, -1] = np.eye(2)
        return out

    def train(self, texts: list[list[str]], marks: list[np.ndarray], rounds: int = 4, rate: float = 0.5) -> None:
        """AdaGrad on the log likelihood, over pieces of at most STEP words."""
        ids: dict[str, int] = {}
        for words in texts:
            for w in words:
                ids.setdefault(w, len(ids))
        table = features(list(ids))
        cut = [(np.fromiter(map(ids.__getitem__, t[k : k + STEP]), np.int32), y[k : k + STEP]) for t, y in zip(texts, marks) for k in range(0, len(t), STEP)]
        order = np.random.default_rng(7).permutation(len(cut))
        size_w, size_m = np.full(self.w.shape, 1e-6), np.full((2, 2), 1e-6)
        for _ in range(rounds):
            for k in range(0, len(order), 256):
                batch = sorted((cut[i] for i in order[k : k + 256]), key=lambda x: len(x[0]))
                sizes = np.array([len(b[0]) for b in batch])
                words, y = np.zeros((sizes.max(), len(batch)), np.int32), np.zeros((sizes.max(), len(batch)))
                for i, (w, marked) in enumerate(batch):
                    words[: len(w), i], y[: len(w), i] = w, marked
                here = np.arange(len(words))[:, None] < sizes
                p, moves = self.marginals(self.w[table[words]].sum(axis=2), sizes)
                step = np.bincount(table[words[here]].ravel(), np.repeat((y - p)[here], 7), 1 << BITS) / len(batch)
                size_w += step**2
                self.w += (rate * step / np.sqrt(size_w)).astype(np.float32)
                a, b = y[:-1].astype(int), y[1:].astype(int)
                seen = np.bincount((2 * a + b)[here[1:]], minlength=4).reshape(2, 2)
                step = (seen - moves) / here.sum()
                size_m += step**2
                self.move += rate * 0.2 * step / np.sqrt(size_m)


def unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum()


def prefixes(steps: np.ndarray) -> np.ndarray:
    """Products of the steps of each block up to each place, scaled; [place, from, to, block]."""
    out = np.empty_like(steps)
    out[0] = steps[0]
    for t in range(1, len(steps)):
        # Rows of all products so far, by the state that they have reached.
        x, y, step, now = out[t - 1, :, 0], out[t - 1, :, 1], steps[t], out[t]
        now[:, 0] = x * step[0, 0] + y * step[1, 0]
        now[:, 1] = x * step[0, 1] + y * step[1, 1]
        if t % 4 == 0:
            now /= now.sum(axis=(0, 1))
    out[-1] /= out[-1].sum(axis=(0, 1))
    return out


def suffixes(steps: np.ndarray) -> np.ndarray:
    """Products of the steps of each block after each place, scaled; [place, from, to, block]."""
    out = np.empty_like(steps)
    out[-1] = np.eye(2)[:, :, None]
    for t in range(len(steps) - 1, 0, -1):
        x, y, step, now = out[t, 0], out[t, 1], steps[t], out[t - 1]
        now[0] = step[0, 0] * x + step[0, 1] * y
        now[1] = step[1, 0] * x + step[1, 1] * y
        if t % 4 == 0:
            now /= now.sum(axis=(0, 1))
    return out


def product(blocks: np.ndarray) -> np.ndarray:
    """The product of all blocks' products in their order, scaled."""
    out = np.eye(2)
    for block in np.moveaxis(blocks, -1, 0):
        out = out @ block
        out /= out.sum()
    return out


def filled(steps: np.ndarray, into: np.ndarray, out_of: np.ndarray) -> np.ndarray:
    """P(toxic) of every word, given the state before the first block and after the last."""
    fore = prefixes(steps)
    whole = np.moveaxis(fore[-1], -1, 0)
    before, after = np.empty((len(whole), 2)), np.empty((len(whole), 2))
    before[0], after[-1] = into, out_of
    for c in range(1, len(whole)):
        before[c] = unit(before[c - 1] @ whole[c - 1])
    for c in range(len(whole) - 2, -1, -1):
        after[c] = unit(whole[c + 1] @ after[c + 1])
    alpha = fore[:, 0] * before[:, 0] + fore[:, 1] * before[:, 1]
    back = suffixes(steps)
    beta = back[:, :, 0] * after[:, 0] + back[:, :, 1] * after[:, 1]
    both = alpha * beta
    return (both[:, 1] / both.sum(axis=1)).T.ravel()


def evidence(p: np.ndarray) -> list[float]:
    """What a document's score sees of its marginals."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0]
    total = float(p.sum())
    return [1.0, math.log1p(total), min(1.0, 20.0 * total / len(p)), float(p.max())]


class Model:
    """A trained field and the logistic weights of a document."""

    def __init__(self, field: Field, weights: list[float]):
        self.field, self.weights = field, weights

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of whole texts, given as words."""
        return self.of_scores([self.field.emissions(t, {}) for t in texts])

    def of_scores(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Marginals of whole texts, given as their words' scores."""
        ends = np.cumsum([len(s) for s in scores])
        starts = [e - len(s) for e, s in zip(ends, scores) if len(s)]
        return np.split(self.field.whole_marginals(np.concatenate(scores), np.array(starts, int)), ends[:-1]) if len(scores) else []

    def score(self, p: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, evidence(p)))))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * len(y) * w * (np.arange(len(w)) > 0))
    return w


def fit(rows: list[tuple[str, int]], share: float | None = None) -> Model:
    """A model from (text, label) rows.

    ``share`` is the true share of toxic rows where the sample is balanced differently.
    """
    labels = [y for _, y in rows]
    if len(set(labels)) < 2:
        # One kind of label only: a constant score.
        rate = (sum(labels) + 0.0) / max(1, len(labels)) if share is None else share
        return Model(Field(), [30.0 if rate >= 1 else -30.0 if rate <= 0 else math.log(rate / (1 - rate)), 0.0, 0.0, 0.0])
    # One object per distinct word: the texts of the sample repeat few words.
    same: dict[str, str] = {}
    texts = [[same.setdefault(w, w) for w in words_of(t)] for t, _ in rows]
    forms = toxic_forms(texts, labels)
    marked: dict[str, bool] = {}

    def mark(word: str) -> bool:
        if word not in marked:
            marked[word] = any(f in forms for f in beginnings(word))
        return marked[word]

    marks = [np.array([mark(w) for w in t], float) * y if y else np.zeros(len(t)) for t, y in zip(texts, labels)]
    field = Field()
    field.train(texts, marks)
    model = Model(field, [0.0] * 4)
    known: dict[str, float] = {}
    x = np.array([evidence(p) for k in range(0, len(texts), 512) for p in model.of_scores([field.emissions(t, known) for t in texts[k : k + 512]])])
    y = np.array(labels, float)
    model.weights = logistic(x, y).tolist()
    if share is not None and 0 < share < 1:
        mean = y.mean()
        model.weights[0] += math.log(share / (1 - share)) - math.log(mean / (1 - mean))
    return model


def learn(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    known = columns(labels, id="doc_id", y=label).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    return fit(sample(docs, doc_id, text, labels, label, per_class, max_bytes), known.agg(F.avg("y")).first()[0])


def score(docs: DataFrame, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` and toxic ``spans`` of characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # A task unpickles this function, so it has words of its own, and gives them up when it ends.
    known: dict[str, float] = {}

    def make(texts: list[str | None]) -> list[list]:
        model = shared.value
        words = [[w for piece in PIECE.findall(t.lower()) for w in WORD.findall(piece)] if t else [] for t in texts]
        scores = model.field.emissions(list(chain.from_iterable(words)), known)
        found = model.of_scores(np.split(scores, np.cumsum([len(w) for w in words])[:-1]) if texts else [])
        return [[model.score(p) for p in found], [spans_of(t, p) for t, p in zip(texts, found)]]

    return map_rows(docs, text, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))]), make, keep)


def spans_of(text: str | None, p: np.ndarray) -> list[dict]:
    """Runs of words that are toxic rather than not, with the largest marginal in them."""
    if not len(p) or p.max() <= 0.5:
        return []
    out, before = [], -2
    # Some characters lower-case to two: offsets are those of the lower-cased text then.
    for i, word in enumerate(WORD.finditer(text.lower())):
        if p[i] > 0.5:
            if before == i - 1:
                out[-1]["end"], out[-1]["p"] = word.end(), max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": word.start(), "end": word.end(), "p": float(p[i])})
            before = i
    return out
