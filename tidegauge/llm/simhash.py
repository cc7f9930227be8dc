"""SimHash near-duplicates: links by pigeonring chains, classes by connected components.

A fingerprint has 64 bits; two link when at most ``threshold`` (4) bits differ. It is
seen as a ring of five segments. If the differences of a pair sum up to 4, then by the
pigeonring principle there is a segment from which on every chain of 1, 2, 3, 4 and 5
consecutive segments has at most 4/5 of a bit per segment: 0, 1, 2, 3 and 4 bits. A
chain's first segment is therefore equal and its second differs in one bit at most, so
that one half of the second is equal as well: each distinct fingerprint goes to ten
buckets (segment, half of the next one), and within a bucket the longer chains prune
the pairs before the full Hamming distance is taken.

Equal fingerprints are one node, however many documents have them. A bucket never
gives its pairs but a spanning forest of its links: at most one edge per member. A
bucket of more than ``block`` nodes is cut into blocks, and every two blocks meet in
one task, so no task holds more than two blocks. The components of the edges are found
by alternating large-star and small-star rounds with a written table between them.

A null or empty text, or one without words, has fingerprint zero and is linked like
any other. Repeated rows are rows of their own with one class. A class whose ids are
all null has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.components import components
from tidegauge.llm.rows import map_arrow, map_rows, numbered, restored, staged

#: (lowest bit, width) of the ring's segments.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
SEED = 42


def chain_mask(first: int, n: int) -> int:
    """The bits of ``n`` consecutive segments of the ring."""
    return sum(((1 << width) - 1) << low for low, width in (SEGMENTS[(first + j) % len(SEGMENTS)] for j in range(n)))


#: Length of a chain -> its bits, by its first segment.
CHAINS = {n: np.array([chain_mask(i, n) for i in range(len(SEGMENTS))], np.uint64) for n in (2, 3, 4)}


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """XXH64 of every shingle, repeats included; A-Z in lower case."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, ends)], np.uint64, n)


def fingerprint(text: str | None, words: int = 4) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, words: int = 4, out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the fingerprint of its text as a signed 64-bit integer."""
    def make(texts: list[str | None]) -> list:
        return [np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64).tolist()]

    return map_rows(docs, text, T.StructType([T.StructField(out, T.LongType())]), make, keep)


def buckets(nodes: DataFrame) -> DataFrame:
    """Ten rows (key, fp) per fingerprint: a segment and one half of the next one.

    The key holds the number of the bucket kind above the 26 or so bits it stands for.
    """
    def bits(low: int, width: int):
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    keys = []
    for i, (low, width) in enumerate(SEGMENTS):
        at, n = SEGMENTS[(i + 1) % len(SEGMENTS)]
        for half, (start, size) in enumerate([(at, n // 2), (at + n // 2, n - n // 2)]):
            kind = F.lit((2 * i + half) << 40).cast("long")
            keys.append(kind + F.shiftleft(bits(low, width), 8) + bits(start, size))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def close(a: np.ndarray, b: np.ndarray, segment: np.ndarray | int, threshold: int) -> np.ndarray:
    """Which pairs link: chains from ``segment`` within their budgets, then all bits."""
    x = a ^ b
    good = np.ones(x.shape, bool)
    for n, mask in CHAINS.items():
        at = np.flatnonzero(good)
        if not len(at):
            return good
        m = mask[segment] if np.isscalar(segment) else mask[segment[at]]
        good[at] = np.bitwise_count(x[at] & m) <= threshold * n // 5
    at = np.flatnonzero(good)
    good[at] = np.bitwise_count(x[at]) <= threshold
    return good


def forest(fps: np.ndarray, segment: int, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of one bucket: a walk that only looks at nodes not yet reached."""
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = close(rest, x, segment, threshold)
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), x, np.uint64), found))
                queue.extend(found)
                rest = rest[~near]
    return out


SMALL = 48


def edges_of(keys: np.ndarray, fps: np.ndarray, kinds: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges within runs of equal keys. Small runs are compared all at once, by distance in the run."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(cuts)
    for i in np.flatnonzero(sizes > SMALL):
        run = slice(cuts[i], cuts[i + 1])
        yield from forest(np.unique(fps[run]), int(kinds[cuts[i]]) // 2, threshold)
    small = np.repeat(sizes <= SMALL, sizes)
    keys, fps, kinds = keys[small], fps[small], kinds[small]
    for gap in range(1, SMALL):
        at = np.flatnonzero(keys[gap:] == keys[:-gap]) if len(keys) > gap else []
        if not len(at):
            return
        good = close(fps[at], fps[at + gap], kinds[at] // 2, threshold)
        if good.any():
            yield fps[at[good]], fps[at[good] + gap]


def links(nodes: DataFrame, threshold: int = 4, block: int = 4096) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct ``fp``."""
    if not 0 <= threshold <= 4:
        raise ValueError("the ring of five segments holds for thresholds from 0 to 4")
    rows = buckets(nodes)
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(counts, "key")
    # Members of a large bucket go to one of its blocks, and once to each pair of blocks that this one is in.
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("mine")) * F.col("blocks") + F.greatest(j, F.col("mine")))
    large = (
        rows.where(F.col("n") > block).withColumn("blocks", blocks).withColumn("mine", mine)
        .withColumn("part", F.explode(pairs)).select("key", "part", "fp")
    )
    grouped = rows.where(F.col("n") <= block).select("key", F.lit(-1).alias("part"), "fp").union(large)
    grouped = grouped.repartition("key", "part").sortWithinPartitions("key", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def found(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, part, fp = parts
            if len(key) < 2:
                return
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            for a, b in edges_of(group, fp.view(np.uint64), key >> 40, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            new = [np.asarray(batch.column(i), np.int64) for i in range(3)]
            held = [np.concatenate(x) for x in zip(held, new)]
            # The last bucket may go on in the next batch.
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut >= 1 << 16:
                yield from found([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        yield from found(held)

    return map_arrow(grouped, run, "a bigint, b bigint")


def classes(docs: DataFrame, doc_id: str, text: str, words: int = 4, threshold: int = 4, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fp``, ``label`` (one per class) and ``component_id``, the class's smallest id.

    With ``keep`` (which does not hold the text) the fingerprints are computed once and
    written; else texts are read a second time rather than stored again. Columns of
    these three names are replaced.
    """
    docs = docs.drop("fp", "label", "component_id")
    marked = fingerprints(docs, text, words, keep=keep)
    if keep is not None:
        marked = ids = staged(marked, "simhash-fingerprints")
    else:
        ids = fingerprints(docs, text, words, keep=[doc_id])
    nodes = staged(ids.groupBy("fp").agg(F.min(f"`{doc_id}`").alias("id")), "simhash-nodes")
    labels = components(links(nodes.select("fp"), threshold))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = named.groupBy("label").agg(F.min("id").alias("component_id"))
    return marked.join(named.select("fp", "label").join(ids, "label"), "fp")


def keep_one(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns of ``docs``; of each class the row of the smallest id (any one of equal ids)."""
    rows, name = numbered(docs)
    found = classes(rows, name(doc_id), name(text))
    first = found.where(F.col(name(doc_id)).eqNullSafe(F.col("component_id")))
    return restored(first.dropDuplicates(["label"]), docs.columns)
