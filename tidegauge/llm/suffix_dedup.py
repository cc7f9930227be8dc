"""Removal of long byte strings that occur more than once in a corpus.

A byte goes if a string of ``length`` (200) bytes around it starts anywhere else too,
in the same document or another. Suffix sorting decides that, in buckets that no task
has to hold whole:

1. Of the 80-byte strings in every 200 bytes the one of smallest hash is the anchor.
   Equal 200-byte strings have equal anchors, so the anchor is the suffix bucket. The
   starts with one anchor are a run; a document of n bytes has about n / 60 runs, and
   only hashes of them are shuffled. An anchor that occurs once ends here.
2. Runs of equal text are one class, counted with map-side combine; all starts of a
   class of two or more are repeated. What is left open is the classes of an anchor
   where some class occurs once: runs at the edge of a repeated passage.
3. Only one text of each open class is fetched. Its buckets are sorted block by block
   with a difference cover (see difference_cover). An anchor of more than
   ``bucket_limit`` open classes does not go to one task: its starts are counted one
   by one, by a 128-bit hash of their 200 bytes, with map-side combine.
4. The spans of a text are merged and cut out once per distinct text.

Texts are known by two 64-bit hashes. A null text counts as empty; texts under 200
bytes lose nothing; of exact copies every one is cut alike; repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.difference_cover import repeated
from tidegauge.llm.rows import map_arrow, numbered, restored, staged

LENGTH, ANCHOR = 200, 80
#: Bytes that are hashed, or sorted, at a time.
CHUNK, BLOCK = 1 << 19, 1 << 19
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
BASE = 0x9E3779B97F4A7C15 | 1
RUN = "h bigint, g bigint, t1 bigint, t2 bigint, start int, n int"


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


POWER, INVERSE = powers(BASE, CHUNK + 1), powers(pow(BASE, -1, 1 << 64), CHUNK + 1)


def anchors(data: np.ndarray, length: int = LENGTH, width: int = ANCHOR) -> np.ndarray:
    """For each start of ``length`` bytes, the position of its anchor (CHUNK bytes at most)."""
    n = len(data) - width + 1
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWER[: len(data)])])
    key = (total[width:] - total[:-width]) * INVERSE[:n]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    # The smallest hash, and of equal ones the last position.
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
    window = length - width + 1
    rows = -(-n // window)
    key = np.concatenate([key, np.full(rows * window - n, 2**64 - 1, np.uint64)]).reshape(rows, window)
    fore = np.minimum.accumulate(key, axis=1).ravel()
    back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - window + 1
    least = np.minimum(back[:count], fore[window - 1 : window - 1 + count])
    return (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def runs_of(data: memoryview, sizes: np.ndarray, length: int = LENGTH) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Runs of documents that lie one after another in ``data``: (document, start, n), and h and g."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    raw = np.frombuffer(data, np.uint8)
    owners, starts, counts, h, g = [], [], [], [], []
    digest = xxhash.xxh3_64_intdigest
    step = CHUNK - length
    for base in range(0, max(1, len(raw) - length + 1), step):
        piece = raw[base : base + CHUNK]
        if len(piece) < length:
            break
        at = anchors(piece)[:step]
        place = np.arange(len(at)) + base
        doc = np.searchsorted(ends, place, "right")
        good = place + length <= ends[doc]
        at, place, doc = at[good] + base, place[good], doc[good]
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
        n = np.diff(np.append(first, len(at)))
        for a, s, e in zip(at[first].tolist(), place[first].tolist(), (place[first] + n + length - 1).tolist()):
            h.append(digest(data[a : a + ANCHOR]))
            g.append(digest(data[s:e]))
        owners.append(doc[first])
        starts.append(place[first] - begins[doc[first]])
        counts.append(n)
    if not owners:
        return [np.zeros(0, np.int64)] * 3, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return [np.concatenate(x) for x in (owners, starts, counts)], np.array(h, np.uint64).view(np.int64), np.array(g, np.uint64).view(np.int64)


def pieces(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[pa.RecordBatch, memoryview, np.ndarray]]:
    """Slices of about ``size`` bytes with their binary values as one buffer."""
    values = batch.column(column)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = memoryview(values.buffers()[2] or b"")
    start = 0
    while start < len(values):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        stop = min(stop, len(values))
        yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], np.diff(offsets[start : stop + 1])
        start = stop


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with t1 and t2, which stand for the text, and the text's bytes as ``data``."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumns({"t1": F.xxhash64(raw), "t2": F.xxhash64(F.lit(LENGTH), raw), "data": raw.cast("binary")})


def runs(texts: DataFrame) -> DataFrame:
    """(h, g, t1, t2, start, n) of every run: hashes of anchor and text, and where it is."""
    names = [x.split()[0] for x in RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, sizes in pieces(batch, "data", CHUNK - LENGTH):
                (owner, start, n), h, g = runs_of(data, sizes)
                own = [np.asarray(part.column(c), np.int64)[owner] for c in ("t1", "t2")]
                arrays = [pa.array(h), pa.array(g), *map(pa.array, own), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(texts.select("t1", "t2", "data"), run, RUN)


def cut(texts: DataFrame) -> DataFrame:
    """(h, g, c, text): the texts of the runs listed per document in column ``want``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("data")[i].as_buffer()
                want = batch.column("want")[i].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["h"] for x in want], pa.int64()), pa.array([x["g"] for x in want], pa.int64()),
                    pa.array([x["c"] for x in want], pa.int64()), pa.array([x["k"] for x in want], pa.int64()),
                    pa.array([data[x["start"] : x["start"] + x["n"] + LENGTH - 1].to_pybytes() for x in want], pa.binary()),
                ], ["h", "g", "c", "k", "text"])

    return map_arrow(texts.select("data", "want"), run, "h bigint, g bigint, c bigint, k bigint, text binary")


def spans_of(flags: np.ndarray) -> list[dict]:
    """Runs of true flags as [start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def sorted_buckets(classes: DataFrame) -> DataFrame:
    """(h, g, starts): repeated starts of open classes that occur once, a block of buckets at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        used = 0

        def done(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            h = np.array([r[0] for r in rows], np.int64)
            number = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
            flags = repeated([r[3] for r in rows], number, LENGTH)
            found = [(r, spans_of(f)) for r, f in zip(rows, flags) if r[2] == 1 and f.any()]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r, _ in found], pa.int64()), pa.array([r[1] for r, _ in found], pa.int64()),
                pa.array([s for _, s in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], ["h", "g", "starts"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "g", "c", "text"))):
                if used > BLOCK and held[-1][0] != row[0]:
                    yield from done(held)
                    held, used = [], 0
                held.append(row)
                used += len(row[3])
        yield from done(held)

    rows = classes.select("h", "g", "c", "text").repartition("h").sortWithinPartitions("h", "g")
    return map_arrow(rows, run, T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField("starts", T.ArrayType(SPAN))]))


def counted_starts(classes: DataFrame) -> DataFrame:
    """(h, g, starts) like sorted_buckets, for anchors of very many classes: every start counted by its own string."""
    schema = "h bigint, g bigint, c bigint, at bigint, p1 bigint, p2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, g, c, text in zip(*(batch.column(x).to_pylist() for x in ("h", "g", "c", "text"))):
                both = [xxhash.xxh3_128_intdigest(text[i : i + LENGTH]) for i in range(len(text) - LENGTH + 1)]
                n = len(both)
                yield pa.RecordBatch.from_arrays([
                    pa.array([h] * n), pa.array([g] * n), pa.array([c] * n), pa.array(range(n), pa.int64()),
                    pa.array([signed(x >> 64) for x in both], pa.int64()), pa.array([signed(x & (1 << 64) - 1) for x in both], pa.int64()),
                ], ["h", "g", "c", "at", "p1", "p2"])

    starts = map_arrow(classes.select("h", "g", "c", "text"), run, schema)
    twice = starts.groupBy("p1", "p2").agg(F.sum("c").alias("n")).where("n > 1").select("p1", "p2")
    found = starts.where("c = 1").join(twice, ["p1", "p2"], "left_semi")
    one = F.struct(F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    return found.groupBy("h", "g").agg(F.collect_list(one).alias("starts"))


def per_text(docs: DataFrame, text: str, characters: bool = False, bucket_limit: int = 4096) -> DataFrame:
    """(t1, t2, n_bytes, spans, kept) of every distinct text: what goes and the bytes that stay.

    With ``characters`` a character that a span would split stays whole.
    """
    texts = keyed(docs.select(F.col(f"`{text}`").alias("text")), "text").select("t1", "t2", "data")
    all_runs = runs(texts)
    # Written first: a join of two shuffled sides is one whose hot keys Spark can split.
    anchors_twice = staged(all_runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    found = staged(all_runs.join(anchors_twice, "h", "left_semi"), "runs")
    classes = found.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("t1", "t2", "start", "n")).alias("one"))
    classes = staged(classes, "classes")
    open_anchors = classes.groupBy("h").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 AND least = 1").select("h", "k")
    open_anchors = staged(open_anchors, "open-anchors")
    want = (
        classes.join(open_anchors, "h").select("one.t1", "one.t2", F.struct("h", "g", "c", "k", "one.start", "one.n").alias("w"))
        .groupBy("t1", "t2").agg(F.collect_list("w").alias("want"))
    )
    distinct = texts.groupBy("t1", "t2").agg(F.first("data").alias("data"))
    fetched = staged(cut(distinct.join(want, ["t1", "t2"])), "open-runs")
    solved = sorted_buckets(fetched.where(F.col("k") <= bucket_limit)).union(counted_starts(fetched.where(F.col("k") > bucket_limit)))
    ranges = classes.where("c > 1").select("h", "g", all_starts()).union(solved)
    spans = (
        found.join(ranges, ["h", "g"])
        .select("t1", "t2", F.explode(F.transform("starts", lambda s: F.struct(
            (F.col("start") + s.start).alias("start"), (F.col("start") + s.end + LENGTH - 1).alias("end")))).alias("s"))
        .groupBy("t1", "t2").agg(F.collect_set("s").alias("spans"))
    )
    return removed(distinct.join(spans, ["t1", "t2"], "left"), characters)


def all_starts():
    """All starts of a class's runs."""
    return F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("one.n").cast("long").alias("end"))).alias("starts")


def removed(texts: DataFrame, characters: bool) -> DataFrame:
    """Merge the spans of each text and cut them out."""
    schema = T.StructType([
        T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(SPAN)), T.StructField("kept", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                data = part.column("data").to_pylist()
                merged, kept = [], []
                for raw, spans in zip(data, part.column("spans").to_pylist()):
                    own = merge(spans or [])
                    merged.append([{"start": a, "end": b} for a, b in own])
                    edges = [0, *(x for s in (whole_characters(raw, own) if characters else own) for x in s), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if own else raw)
                yield pa.RecordBatch.from_arrays([
                    part.column("t1"), part.column("t2"), pa.array([len(x) for x in data], pa.int64()),
                    pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
                ], schema.fieldNames())

    return map_arrow(texts.select("t1", "t2", "data", "spans"), run, schema)


def whole_characters(raw: bytes, spans: list[list[int]]) -> list[list[int]]:
    """The spans without the parts of characters at their ends (bytes 10xxxxxx go on with one)."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append([a, b])
    return out


def merge(spans: list[dict]) -> list[list[int]]:
    """Maximal runs: spans that overlap or touch become one."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut_documents(docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` with the repeated strings cut out of the text.

    A character that a cut would split stays whole. A null text stays null.
    """
    rows, name = numbered(docs)
    own = keyed(rows, name(text)).drop("data").withColumn("none", F.col(name(text)).isNull()).drop(name(text))
    kept = per_text(docs, text, characters=True).select("t1", "t2", F.col("kept").cast("string").alias("kept_text"))
    out = own.join(kept, ["t1", "t2"]).withColumn(name(text), F.when(~F.col("none"), F.col("kept_text")))
    return restored(out, docs.columns)
