"""Mixing sources to target weights by balanced sampling with the cube method.

Sources get weights in the order of their names and share a multiple of all words; a
source's target stops at a multiple of its own size and what it cannot take is shared
again. A document of a source that is to be taken t times is taken floor(t) times, and
once more with inclusion probability t - floor(t). These probabilities are moved, within
each source, along vectors of the null space of two constraints, the number of documents
and the number of words taken, until they are 0 or 1 (flight). With two constraints, three
fractional documents always have such a vector, so at most two stay fractional.

Sources are cut into blocks of documents by hash, and blocks fly by themselves: each keeps
its totals. What stays fractional is dealt into new, far fewer blocks, and so on until
a source has one block. There a few documents of spread sizes are held back, and the
landing decides them and the fractional rest together: of all outcomes, the one with
the smallest error in words, then in documents. Directions are drawn by hash, so
results repeat, however the rows are dealt.

Copies of one document (equal source, id, size and text) are one unit: of m copies floor(m p)
are taken once more, which is a move along differences of equal columns, and the rest is
one fractional document. So a document that a third of all rows repeat is one row.

A null text has no words. Null ids and sources are values like any other; the null source
comes last. Documents without a word count as documents. Tables without a word have
targets of 0; an empty table gives no rows. Other columns, whatever their names, stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.ranking import numbered_in_order
from tidegauge.llm.rows import columns, map_arrow, staged

#: Fractional documents of a block, on average; documents held back for the landing, of
#: different sizes and of the smallest.
BLOCK, HELD, SMALLEST = 2_000, 10, 4
EDGE = 1e-9
UNIT = ["source", "id", "size", "t", "copies"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def units(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """A row per distinct document, with its size and number of copies."""
    rows = columns(docs, id=doc_id, source=source, text=text)
    return rows.select("source", "id", words(F.col("text")).alias("size"), F.xxhash64("text").alias("t")).groupBy("source", "id", "size", "t").agg(F.count("*").alias("copies"))


def targets(found: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``n_units`` and ``target`` of every source.

    The number of sources may be large: they are numbered in order without a window over
    all of them, and each round of sharing is one aggregate.
    """
    sizes = found.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_units"))
    placed = numbered_in_order(staged(sizes, "sources"), [F.asc_nulls_last("source")], "place")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights)).cast("int"))
    rows = staged(placed.withColumn("weight", weight), "weights")
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    most = limit * F.col("source_size")
    rate, open_weight = 0.0, -1
    while True:
        # Shares only grow from round to round: a source that has stopped stays so.
        stopped = F.col("weight") * F.lit(rate) > most
        state = rows.agg(F.sum(F.when(stopped, most).otherwise(0.0)), F.sum(F.when(stopped, 0).otherwise(F.col("weight")))).first()
        if not state[1] or state[1] == open_weight:
            return rows.withColumn("target", F.when(stopped, most).otherwise(F.col("weight") * F.lit(rate))).drop("weight", "place")
        open_weight = state[1]
        rate = (total - state[0]) / open_weight


def step(p: Sequence[float], x: Sequence[float]) -> list[float]:
    """A direction that changes neither the sum of p nor that of p * x, of up to three documents."""
    if len(p) == 3:
        u = [x[2] - x[1], x[0] - x[2], x[1] - x[0]]
        if any(u):
            return u
        return [1.0, -1.0, 0.0]
    return [1.0, -1.0] if len(p) == 2 and x[0] == x[1] else []


def fly(p: list[float], x: Sequence[float], draws: Sequence[float]) -> list[int]:
    """Move probabilities to 0 or 1 in place, in the given order; the places that stay fractional."""
    open_: list[int] = []
    for i in range(len(p)):
        if not EDGE < p[i] < 1 - EDGE:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        while u := step([p[j] for j in open_[:3]], [x[j] for j in open_[:3]]):
            ahead = min((1 - p[j]) / v if v > 0 else p[j] / -v for j, v in zip(open_, u) if v)
            behind = min(p[j] / v if v > 0 else (1 - p[j]) / -v for j, v in zip(open_, u) if v)
            # A martingale: the way ahead is as likely as it is short.
            far = ahead if draws[i] * (ahead + behind) < behind else -behind
            for j, v in zip(open_, u):
                p[j] += far * v
            for j in open_:
                if not EDGE < p[j] < 1 - EDGE:
                    p[j] = float(round(p[j]))
            open_ = [j for j in open_ if 0 < p[j] < 1]
    return open_


def land(p: list[float], x: Sequence[float], left: list[int]) -> None:
    """Decide the places ``left``: the outcome nearest in words, then in documents."""
    if not left:
        return
    outcomes = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    sizes, chances = np.array([x[j] for j in left]), np.array([p[j] for j in left])
    in_words = np.round(np.abs(outcomes @ sizes - chances @ sizes), 6)
    in_documents = np.round(np.abs(outcomes.sum(axis=1) - chances.sum()), 6)
    best = outcomes[np.lexsort((in_documents, in_words))[0]]
    for j, taken in zip(left, best.tolist()):
        p[j] = float(taken)


def held_back(n: int, count: int) -> set[int]:
    """Places of up to ``count`` of n documents in order of falling size: the largest, the smallest, and some between."""
    return set(range(n)) if n <= count else {round((n - 1) * (k / (count - 1)) ** 2) for k in range(count)}


def decide(p: list[float], x: list[float], draws: list[float], last: bool) -> None:
    """Fly a block, ordered by falling size; land it if it is the last of its source."""
    if not last:
        fly(p, x, draws)
        return
    fractional = [i for i in range(len(p)) if EDGE < p[i] < 1 - EDGE]
    # Large steps come from different sizes, the last few words from several small documents.
    sizes = list({x[i]: i for i in fractional if x[i]}.values())
    held = {sizes[k] for k in held_back(len(sizes), HELD)}
    held.update([i for i in fractional if x[i] and i not in held][-SMALLEST:])
    flying = [i for i in range(len(p)) if i not in held]
    own = [p[i] for i in flying]
    rest = fly(own, [x[i] for i in flying], [draws[i] for i in flying])
    for i, v in zip(flying, own):
        p[i] = v
    land(p, x, [*(flying[k] for k in rest), *sorted(held)])


def flown(rows: DataFrame, counted: DataFrame, level: int, block: int) -> DataFrame:
    """``rows`` (units with p) after a flight of each block; ``counted`` has the n of each source.

    A block is a hash range of its source; it is read by one task, sorted, a block at a time.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block))).cast("long")
    n_of = counted.select(F.col("source").alias("of"), "n")
    hashed = rows.join(n_of, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("h", F.xxhash64(F.lit(level), *UNIT))
    dealt = hashed.withColumn("block", F.pmod(F.col("h"), blocks)).withColumn("last", blocks == 1).drop("n")
    by = ["source", "block"]
    ordered = dealt.repartition(*by).sortWithinPartitions(*by, F.desc("size"), "h", "id", "t")
    names = [*rows.columns]

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        p = whole.column("p").to_pylist()
        draws = ((whole.column("h").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        decide(p, [float(v) for v in whole.column("size").to_pylist()], draws.tolist(), whole.column("last")[0].as_py())
        return whole.set_column(whole.column_names.index("p"), "p", pa.array(p, pa.float64())).select(names).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = list(zip(batch.column("source").to_pylist(), batch.column("block").to_pylist()))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if held and keys[start] != key:
                        yield solved(held)
                        held = []
                    held.append(batch.slice(start, i - start))
                    key, start = keys[start], i
        if held:
            yield solved(held)

    return map_arrow(ordered, run, rows.schema)


def plan(
    docs: DataFrame, doc_id: str, text: str, source: str,
    weights: Sequence[int] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block: int = BLOCK,
) -> DataFrame:
    """A row per distinct document: id, source, size, t (hash of the text), copies (rows of
    it), source_size, target, ``each`` (times that every copy is taken) and ``more`` (copies that are taken once more)."""
    found = staged(units(docs, doc_id, text, source), "units")
    known = staged(targets(found, weights, share, limit), "targets")
    of = known.withColumnRenamed("source", "of")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = found.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of", "n_units").withColumn("times", times)
    rows = rows.withColumn("each", F.floor("times")).withColumn("all", F.col("copies") * (F.col("times") - F.col("each")))
    # Of equal documents all but one are decided at once.
    rows = rows.withColumn("more", F.floor(F.col("all") + F.lit(EDGE))).withColumn("p", F.greatest(F.lit(0.0), F.col("all") - F.col("more"))).drop("all", "times")
    left, counted, level, pieces = rows, known.select("source", F.col("n_units").alias("n")), 0, []
    while True:
        now = staged(flown(left, counted, level, block), f"flight-{level}")
        fractional = F.col("p").between(EDGE, 1 - EDGE)
        pieces.append(now.where(~fractional))
        left, level = now.where(fractional), level + 1
        counted = staged(left.groupBy("source").agg(F.count("*").alias("n")), "fractional")
        if counted.isEmpty():
            break
    done = pieces[0]
    for piece in pieces[1:]:
        done = done.unionByName(piece)
    return done.withColumn("more", F.col("more") + F.round("p").cast("long")).drop("p")


def expanded(planned: DataFrame) -> DataFrame:
    """A row per row of the documents, with ``taken``: the words that the mix takes of it."""
    rows = planned.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.withColumn("taken", F.col("size") * (F.col("each") + F.when(F.col("copy") <= F.col("more"), 1).otherwise(0)))


def mixed(docs: DataFrame, planned: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """The mix itself: id, source and text of every taken document, as often as it is taken."""
    rows = columns(docs, id=doc_id, source=source, text=text).withColumn("t", F.xxhash64("text")).dropDuplicates(["id", "source", "t"])
    often = planned.where(F.col("each") * F.col("copies") + F.col("more") > 0).select(
        F.col("id").alias("id_"), F.col("source").alias("source_"), F.col("t").alias("t_"), (F.col("each") * F.col("copies") + F.col("more")).alias("often"),
    )
    same = F.col("id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("t") == F.col("t_"))
    return rows.join(often, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("often")))).select(
        F.col("id").alias(doc_id), F.col("source").alias(source), F.col("text").alias(text), "copy",
    )
