"""Byte-level BPE encoding and decoding by a public rank file.

A text is cut into pieces by the tokenizer's pattern. Distinct pieces of a slice of
rows are encoded together: grouped by length into padded matrices, one row each, in
which every row merges its leftmost pair of minimum rank per round; rows that have
no pair left leave the matrix. Ranks of pairs come from an open-addressing table.

The vocabulary (50,000 entries, about 1 MB) has a fixed size and is broadcast.

Null text counts as empty: no ids, no bytes. Repeated rows are encoded like any
other. Pieces of more than ``LONG_PIECE`` bytes (no break in a very long text) merge
on a heap, by the same rule, as a matrix round costs time in their whole length.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidegauge.llm.rows import map_arrow, map_rows

NO_PAIR = np.int32(2**31 - 1)
LONG_PIECE = 512
#: Letters of the common Latin blocks. A text of these and ASCII only is cut by the
#: standard library's faster engine, with the pattern's classes spelled out.
PLAIN_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NOT_PLAIN = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]").search
#: Distinct pieces and their bytes that a task remembers before it starts anew.
MEMORY_PIECES, MEMORY_BYTES = 200_000, 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class PairTable:
    """(left id, right id) -> id of the merged token, by hashing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (ranks[left] << 32 | ranks[right], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := token[:i]) in ranks and (right := token[i:]) in ranks
        ]
        keys = np.array([p[0] for p in pairs], np.uint64)
        values = np.array([p[1] for p in pairs], np.int32)
        bits = max(4, int(2 * max(1, len(pairs))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << bits, NO_PAIR, np.int32)
        slot, left = self.home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            # Of the keys that want a free slot, the last one written gets it.
            self.keys[slot[left[free]]] = keys[left[free]]
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs; NO_PAIR where there is none or a side is padding (-1)."""
        out = np.full(left.shape, NO_PAIR, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[at].astype(np.uint64) << np.uint64(32) | right.ravel()[at].astype(np.uint64)
        slot, flat = self.home(keys), out.ravel()
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            flat[at[hit]] = self.values[slot[hit]]
            go = ~hit & (there != np.uint64(2**64 - 1))
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & self.mask
        return flat.reshape(left.shape)


class Encoder:
    """Encodes texts; remembers pieces within fixed bounds."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: PairTable | None = None):
        self.ranks, self.pairs = ranks, pairs or PairTable(ranks)
        self.any_split = regex.compile(pattern).findall
        self.plain_split = re.compile(pattern.replace(r"\p{L}", PLAIN_LETTERS).replace(r"\p{N}", "0-9").replace(f" ?{PLAIN_LETTERS}+", f" ?[{PLAIN_LETTERS}]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def split(self, text: str) -> list[str]:
        return self.any_split(text) if NOT_PLAIN(text) else self.plain_split(text)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of about one length, merged together as one padded matrix.

        A piece is a column, so that each step runs along memory. Gives the pieces'
        places in the order in which they ended, their counts of ids, and the ids.
        """
        sizes = np.array([len(p) for p in pieces])
        width, n = int(sizes.max()), len(pieces)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.ascontiguousarray(ids.T)
        found = self.pairs.find(ids[:-1], ids[1:])
        parts, order, counts = [], [], []
        rows, left = np.arange(n), sizes.copy()
        while len(rows):
            best = found.min(axis=0) if len(found) else np.full(len(rows), NO_PAIR)
            ended = best == NO_PAIR
            if ended.any():
                parts.append(ids[:, ended].T[np.arange(len(ids)) < left[ended, None]])
                order.append(rows[ended])
                counts.append(left[ended])
                rows, left, best = rows[~ended], left[~ended], best[~ended]
                if not len(rows):
                    break
                longest = int(left.max())
                ids, found = ids[:longest, ~ended], found[: longest - 1, ~ended]
            at, each = (found == best).argmax(axis=0), np.arange(len(rows))
            ids[at, each] = best
            # What stands after the pair moves one place up.
            wide = np.arange(len(found))[:, None]
            np.copyto(ids[:-1], ids[1:], where=wide > at)
            np.copyto(found[:-1], found[1:], where=wide[:-1] >= at)
            ids[-1], found[-1] = -1, NO_PAIR
            left -= 1
            here = np.minimum(at, len(found) - 1)
            before = np.maximum(at - 1, 0)
            found[here, each] = self.pairs.find(ids[here, each], ids[here + 1, each])
            found[before, each] = self.pairs.find(ids[before, each], ids[before + 1, each])
        return np.concatenate(order), np.concatenate(counts), np.concatenate(parts)

    def long(self, piece: bytes) -> np.ndarray:
        """The same merges on a heap of (rank, place), for a very long piece."""
        ids: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NO_PAIR]
        heapq.heapify(heap)
        text = piece
        start_of = {i: i for i in range(n)}

        def offer(i: int) -> None:
            j = ends[i]
            if i >= 0 and j < n and (r := self.ranks.get(text[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = ends[i] if i in start_of else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], ends[i] = rank, ends[j]
            del start_of[j]
            if ends[i] < n:
                before[ends[i]] = i
            ids[j] = -1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([ids[i] for i in start_of], np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Encode new distinct pieces, by buckets of length."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole, buckets = [], {}
        for i, piece in enumerate(raw):
            if piece in self.ranks:
                whole.append(i)
            else:
                n = len(piece)
                width = 0 if n > LONG_PIECE else n if n <= 16 else 16 << (n // 16).bit_length()
                buckets.setdefault(width, []).append(i)
        order = [np.array(whole, np.int64)]
        sizes, flat = [np.ones(len(whole), np.int64)], [self.flat, np.array([self.ranks[raw[i]] for i in whole], np.int32)]
        for i in buckets.pop(0, []):
            ids = self.long(raw[i])
            order.append(np.array([i]))
            sizes.append(np.array([len(ids)]))
            flat.append(ids)
        for width, bucket in buckets.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(bucket), step):
                part = bucket[k : k + step]
                places, counts, ids = self.matrix([raw[i] for i in part])
                order.append(np.array(part)[places])
                sizes.append(counts)
                flat.append(ids)
        counts = np.concatenate(sizes)
        starts = len(self.flat) + np.cumsum(counts) - counts
        n = len(self.sizes)
        self.known.update(zip(map(pieces.__getitem__, np.concatenate(order).tolist()), range(n, n + len(pieces))))
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, counts])
        self.flat = np.concatenate(flat)
        self.used += sum(map(len, raw))

    def encode(self, texts: list[str | None]) -> pa.Array:
        """A list of ids per text."""
        if len(self.known) > MEMORY_PIECES or self.used > MEMORY_BYTES:
            self.forget()
        pieces = [self.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(pieces)).difference(self.known)
        if new:
            self.learn(list(new))
        counts = np.array([len(p) for p in pieces], np.int64)
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encoding(spark: SparkSession, ranks_path: str, pattern: str) -> Callable[[list], pa.Array]:
    """A function for tasks: texts to lists of ids.

    Each task unpickles it, so a task has an encoder, and pieces, of its own, and gives
    them up when it ends; ranks and pairs come from a broadcast of fixed size.
    """
    ranks = load_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, PairTable(ranks)))
    own: list[Encoder] = []

    def run(texts: list[str | None]) -> pa.Array:
        if not own:
            ranks, pairs = shared.value
            own.append(Encoder(ranks, pattern, pairs))
        return own[0].encode(texts)

    return run


def decoding(spark: SparkSession, ranks_path: str) -> Callable[[pa.Array], pa.Array]:
    """A function for tasks: lists of ids to bytes."""
    shared = spark.sparkContext.broadcast(vocabulary(spark, ranks_path))

    def run(lists: pa.Array) -> pa.Array:
        table, starts, sizes = shared.value
        counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        flat = np.asarray(lists.flatten(), np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(sizes)):
            raise ValueError("a token id is outside the vocabulary")
        n = sizes[flat]
        ends = np.cumsum(n)
        data = table[np.repeat(starts[flat] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    return run


def encode(df: DataFrame, text: str, ranks_path: str, pattern: str, out: str = "ids") -> DataFrame:
    """``df`` with the token ids of its text in column ``out`` (array<int>)."""
    to_ids = encoding(df.sparkSession, ranks_path, pattern)
    return map_rows(df, text, T.StructType([T.StructField(out, T.ArrayType(T.IntegerType(), True))]), lambda texts: [to_ids(texts)])


def encode_and_decode(df: DataFrame, text: str, ranks_path: str, pattern: str, out: tuple[str, str] = ("ids", "decoded"), keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ids and the bytes that they stand for, in one pass."""
    to_ids, to_bytes = encoding(df.sparkSession, ranks_path, pattern), decoding(df.sparkSession, ranks_path)

    def make(texts: list[str | None]) -> list:
        ids = to_ids(texts)
        return [ids, to_bytes(ids)]

    added = T.StructType([T.StructField(out[0], T.ArrayType(T.IntegerType(), True)), T.StructField(out[1], T.BinaryType())])
    return map_rows(df, text, added, make, keep)


def decode(df: DataFrame, ids: str, ranks_path: str, out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for in column ``out`` (binary).

    Null ids give no bytes; an id outside the vocabulary is an error.
    """
    to_bytes = decoding(df.sparkSession, ranks_path)
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [to_bytes(part.column(ids))], schema.fieldNames())

    return map_arrow(df, run, schema)


def vocabulary(spark: SparkSession, ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes in one array, with the start and size of each id."""
    by_id = {i: token for token, i in load_ranks(ranks_path).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes
