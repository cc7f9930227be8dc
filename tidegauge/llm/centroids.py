"""Centroid clustering over dictionaries of subvectors.

Vectors become integers and are cut into blocks of a few dimensions. Chunks of vectors
are written once to the shared folder in a lossless form: per block the distinct
subvectors of the chunk, and per vector their codes. A round computes, of each chunk
and block, the squared distances of the distinct subvectors to the centroids' block
once; a vector's distance is the sum of its codes' entries. New centroids come from
how often each cluster has each code. All of it is integer arithmetic, so results do not
depend on how the rows are dealt.

A chunk is bounded, so memory is: no dictionary is shared by all rows. What reaches
the driver are sums of the size of the model (clusters x dimensions).

Rows with a null vector, one of another length, or a null, NaN or infinite component
are left out. Repeated rows and ids are rows like any other; rows with equal ids
are ordered by their components, null ids come last. Fewer vectors than clusters give
fewer clusters; an empty table gives no rows. Components of 2**27 and more after
scaling are an error, as their distances would not be exact. Other columns of the
table, whatever their names, stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.rows import columns, map_arrow, staged, to_arrow
from tidegauge.llm.vectors import integers, scaled, totals, whole

#: Vectors of a chunk: codes fit 16 bits.
CHUNK = 1 << 14


def distinct(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, code of every row) of an integer matrix, column by column."""
    codes = np.zeros(len(block), np.int64)
    for column in block.T:
        _, of_column = np.unique(column, return_inverse=True)
        _, codes = np.unique(codes * (int(of_column.max(initial=0)) + 1) + of_column, return_inverse=True)
    first = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
    first[codes] = np.arange(len(block))
    return block[first], codes


def encoded(vectors: DataFrame, vec_id: str, embedding: str, dim: int, scale: int, width: int) -> DataFrame:
    """A row per chunk: ids, codes by block, the blocks' distinct subvectors and their numbers."""
    rows = columns(vectors, id=vec_id, v=embedding)
    id_type = to_arrow(rows.schema["id"].dataType)
    schema = f"ids array<{rows.schema['id'].dataType.simpleString()}>, codes binary, entries binary, sizes array<int>"
    types = [pa.list_(id_type), pa.binary(), pa.binary(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                places, ints = integers(part.column("v"), dim, scale)
                if not len(places):
                    continue
                made = [distinct(ints[:, b : b + width]) for b in range(0, dim, width)]
                ids = part.column("id").take(pa.array(places)).cast(id_type)
                codes = np.concatenate([c for _, c in made]).astype(np.uint16).tobytes()
                entries = np.concatenate([e.ravel() for e, _ in made]).astype(np.int32).tobytes()
                row = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
                row += [pa.array([x], t) for x, t in zip((codes, entries, [len(e) for e, _ in made]), types[1:])]
                yield pa.RecordBatch.from_arrays(row, ["ids", "codes", "entries", "sizes"])

    return map_arrow(rows, run, schema)


def chunks(batch: pa.RecordBatch, dim: int, width: int) -> Iterator[tuple[int, list[tuple[slice, np.ndarray, np.ndarray]]]]:
    """Place of each chunk of a batch, and (columns, distinct subvectors, codes) of its blocks."""
    for i in range(batch.num_rows):
        sizes = batch.column("sizes")[i].as_py()
        n = len(batch.column("ids")[i])
        codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint16).reshape(len(sizes), n)
        entries, at, blocks = np.frombuffer(batch.column("entries")[i].as_py(), np.int32), 0, []
        for b, size in enumerate(sizes):
            own = slice(b * width, min((b + 1) * width, dim))
            wide = own.stop - own.start
            blocks.append((own, entries[at : at + size * wide].reshape(size, wide).astype(np.int64), codes[b]))
            at += size * wide
        yield i, blocks


def nearest(blocks: list[tuple[slice, np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of a chunk's vectors; ties go to the smaller number."""
    total = None
    for own, entries, codes in blocks:
        partial = ((entries[:, None, :] - centroids[None, :, own]) ** 2).sum(axis=2)
        total = partial[codes] if total is None else np.add(total, partial[codes], out=total)
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def sums(coded: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """Partial sums (cluster, place, total) of the nearest vectors; place -1 counts them."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            for _, blocks in chunks(batch, dim, width):
                cluster, _ = nearest(blocks, centroids)
                out[:, dim] += np.bincount(cluster, minlength=k)
                for own, entries, codes in blocks:
                    often = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries))
                    out[:, own] += often.reshape(k, -1) @ entries
        at = np.flatnonzero(out[:, dim])
        place = np.tile(np.append(np.arange(dim), -1), len(at))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, dim + 1), pa.int32()), pa.array(place, pa.int32()), pa.array(out[at].ravel(), pa.int64())],
            ["cluster", "place", "total"],
        )

    return map_arrow(coded, run, "cluster int, place int, total long")


def moved(centroids: np.ndarray, found: list) -> np.ndarray:
    """Centroids at the floor of their vectors' means; those without vectors stay."""
    of = {(r.cluster, r.place): int(r.total) for r in found}
    out = centroids.copy()
    for c, place in of:
        if place >= 0:
            out[c, place] = of[c, place] // of[c, -1]
    return out


def first(vectors: DataFrame, vec_id: str, embedding: str, k: int, dim: int, scale: int, salt: str) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``salt`` and their id, in that order."""
    rows = columns(vectors, id=vec_id, v=embedding).where(whole(F.col("v"), dim))
    named = rows.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), scaled(F.col("v"), scale).alias("v"))
    found = named.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64).reshape(-1, dim)


def assigned(coded: DataFrame, centroids: np.ndarray, width: int, name: str) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dim = centroids.shape[1]
    kind = coded.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blocks in chunks(batch, dim, width):
                cluster, distance = nearest(blocks, centroids)
                ids = batch.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], [name, "cluster", "distance"])

    return map_arrow(coded, run, f"`{name}` {kind.simpleString()}, cluster int, distance long")


def cluster(
    vectors: DataFrame, vec_id: str, embedding: str, k: int = 40, rounds: int = 5,
    dim: int = 64, scale: int = 256, width: int = 2, salt: str = "2:",
) -> DataFrame:
    """Id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` of every vector."""
    spark = vectors.sparkSession
    coded = staged(encoded(vectors, vec_id, embedding, dim, scale, width), "subvectors")
    centroids = first(vectors, vec_id, embedding, k, dim, scale, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, totals(sums(coded, centroids, width), "cluster", "place"))
    if len(centroids):
        found = staged(assigned(coded, centroids, width, vec_id), "assigned")
    else:
        kind = vectors.schema[vec_id].dataType.simpleString()
        found = spark.createDataFrame([], f"`{vec_id}` {kind}, cluster int, distance long")
    inertia = {r.cluster: int(r.total) for r in totals(found.select("cluster", F.col("distance").alias("total")), "cluster")}
    rows = [(c, n, sum(inertia.values()), centroids[c].tolist()) for c, n in inertia.items()]
    # As many rows as clusters.
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(known, "cluster").select(F.col(f"`{vec_id}`"), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
