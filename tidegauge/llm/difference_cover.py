"""Equal strings of a fixed length in a block of texts, by difference-cover suffix sorting.

A difference cover D modulo v has, for every two positions i and j, a shift d < v with
i + d and j + d both in D modulo v. The suffixes at cover positions (the sample) are
sorted first, to the full depth. Any other suffixes are then sorted one bucket at a
time by their first v bytes only; where that leaves a tie, the precomputed ranks of the
sample suffixes d bytes further decide. Memory is bounded by the block's bytes.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set: every residue modulo 31 is one difference of two members.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes that the bucket sort looks at; not fewer than any shift in use.
PREFIX = 32


def words_at(padded: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """Eight bytes from each position, big-endian, so that integers sort like bytes."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[at + (offset + k)].astype(np.uint64)
    return out


def refine(padded: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort positions by (group, next ``depth`` bytes).

    Gives the order, and for each place in it the number of bytes shared with the one
    before: -1 where the group changes, ``depth`` where all are equal.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    shared = np.full(len(at), depth, np.int64)
    shared[:1] = -1
    shared[1:][g[1:] != g[:-1]] = -1
    for step in range(0, depth, 8):
        # Only runs that are still tied are sorted on.
        tied = shared == depth
        live = tied.copy()
        live[:-1] |= tied[1:]
        places = np.flatnonzero(live)
        if not len(places):
            break
        run = np.cumsum(~tied[places])
        word = words_at(padded, at[order[places]], step)
        if step + 8 > depth:
            word &= ~np.uint64((1 << (8 * (step + 8 - depth))) - 1)
        by = np.lexsort((word, run))
        order[places] = order[places][by]
        word, run = word[by], run[by]
        split = np.flatnonzero((word[1:] != word[:-1]) & (run[1:] == run[:-1]))
        x = word[split + 1] ^ word[split]
        same = np.zeros(len(x), np.int64)
        for k in range(1, 8):
            same += (x >> np.uint64(64 - 8 * k)) == 0
        shared[places[split + 1]] = np.minimum(step + same, depth - 1)
    return order, shared, g


def repeated(texts: list[bytes], buckets: np.ndarray, length: int = 200) -> list[np.ndarray]:
    """Per text, which starts have a ``length``-byte string that also starts elsewhere in its bucket.

    Texts of fewer bytes have no start. Buckets are numbers; equal strings of different
    buckets are not compared.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    ends = np.cumsum(sizes)
    starts = np.maximum(sizes - length + 1, 0)
    at = np.repeat(ends - sizes, starts) + np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    flags = np.zeros(len(at), bool)
    if len(at):
        bucket = np.repeat(np.asarray(buckets, np.int64), starts)
        # The sample: cover positions that some start can reach, sorted to the full depth.
        member = np.zeros(MODULUS, bool)
        member[list(COVER)] = True
        sample = np.flatnonzero(member[np.arange(len(data)) % MODULUS])
        rank_of, shared = np.zeros(len(data) + MODULUS + 1, np.int64), np.zeros(0, np.int64)
        if len(sample):
            order, shared, _ = refine(padded, sample, np.zeros(len(sample), np.int64), length)
            rank_of[sample[order]] = np.arange(len(sample))
        # The suffixes, bucket by bucket, to PREFIX bytes.
        order, near, _ = refine(padded, at, bucket, PREFIX)
        tie = np.cumsum(near < PREFIX)
        lone = np.bincount(tie)[tie] == 1
        places, tie = order[~lone], tie[~lone]
        # Long ties: equal up to d bytes, and at d in the same class of sample suffixes.
        residue = at[places] % MODULUS
        keys, whose = [], []
        for d in range(MODULUS):
            use = np.flatnonzero(member[(residue + d) % MODULUS])
            if len(use):
                classes = np.cumsum(shared < length - d)
                keys.append((tie[use] << 32 | classes[rank_of[at[places[use]] + d]]) * MODULUS + d)
                whose.append(places[use])
        if keys:
            keys, whose = np.concatenate(keys), np.concatenate(whose)
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            twin = np.concatenate([[False], keys[1:] == keys[:-1]])
            twin[:-1] |= twin[1:]
            flags[whose[by[twin]]] = True
    return np.split(flags, np.cumsum(starts)[:-1])
