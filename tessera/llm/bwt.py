"""Burrows-Wheeler transforms of string collections, and their merge.

A collection is a list of byte strings without the byte 255 (UTF-8 never has
it); every string ends with its own end mark, which sorts before all bytes
and, among end marks, by string number. The transform of a collection lists,
in the order of its sorted suffixes, the byte before each (0 for the end mark,
bytes are shifted by one).

``merge`` finds how the sorted suffixes of several collections interleave
without sorting any suffix. It starts with all suffixes of the first, then of
the second, and so on, and refines: reading the bytes before the suffixes in
the present interleave, a stable count by that byte gives the interleave of
the suffixes one byte longer. After round h it is right for the first h bytes.
Places that part in round h have a common prefix of h - 1 bytes; runs of
places that have not parted after ``depth`` rounds are the repeated intervals
of that length.
"""

from __future__ import annotations

import numpy as np


class Transform:
    """Bytes before the sorted suffixes, and where each stands."""

    def __init__(self, before: np.ndarray, string: np.ndarray, offset: np.ndarray):
        self.before, self.string, self.offset = before, string, offset


def transform(strings: list[bytes]) -> Transform:
    """Transform of one collection, by prefix doubling from eight bytes on."""
    size = np.array([len(s) + 1 for s in strings], dtype=np.int64)
    ends = np.cumsum(size)
    n = int(ends[-1])
    raw = np.zeros(n + 8, dtype=np.uint8)
    raw[:n] = np.frombuffer(b"\xff".join(strings) + b"\xff", dtype=np.uint8) + np.uint8(1)  # 255 becomes 0
    string = np.repeat(np.arange(len(strings)), size)
    left = np.repeat(ends, size) - np.arange(n)  # bytes to the end, end mark included
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(j < left, raw[j:j + n], 0).astype(np.uint64)
    order = np.lexsort((np.where(left <= 8, string, 0), key))
    tie = np.where(left <= 8, string + 1, 0)[order]
    rank = _ranks(order, key[order], tie)
    width = 8
    while rank.max(initial=0) < n - 1:
        # An end mark within the first ``width`` bytes has settled the rank.
        second = rank[np.minimum(np.arange(n) + width, n - 1)] + 1
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        rank = _ranks(order, both[order])
        width *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    start = np.repeat(ends - size, size)
    before = np.where(np.arange(n) == start, 0, raw[np.arange(n) - 1]).astype(np.uint8)
    return Transform(before[order], string[order], (np.arange(n) - start)[order])


def _ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    differs = np.zeros(len(order), dtype=bool)
    for k in keys:
        differs[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(differs)
    return rank


def merge(parts: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, parted): the suffixes of all parts, numbered through, in merged
    order, and for each place the round in which it parted from the place
    before it (their common prefix plus one), 0 if not within ``depth`` rounds."""
    sizes = [len(t.before) for t in parts]
    base = np.concatenate(([0], np.cumsum(sizes)))
    n = int(base[-1])
    before = np.concatenate([t.before for t in parts])
    longer = np.empty(n, dtype=np.intp)  # the suffix one byte longer, in its own part
    for k, t in enumerate(parts):
        longer[base[k] + np.argsort(t.before, kind="stable")] = np.arange(base[k], base[k + 1])
    ends = np.concatenate([np.arange(base[k], base[k] + np.count_nonzero(t.before == 0)) for k, t in enumerate(parts)])
    counts = np.bincount(before, minlength=256)
    first = (np.cumsum(counts) - counts)[counts > 0]
    suffix, held = np.arange(n), np.empty(n, dtype=np.intp)
    byte = np.empty(n, dtype=np.uint8)
    parted = np.zeros(n, dtype=np.int16)
    apart = np.zeros(n, dtype=np.int32)
    block, source = np.zeros(n, dtype=np.int32), np.empty(n, dtype=np.int32)
    new = np.empty(n, dtype=bool)
    for h in range(1, depth + 1):
        # "clip" only spares the check of indexes, which are all within bounds.
        order = np.argsort(np.take(before, suffix, out=byte, mode="clip"), kind="stable")
        np.take(longer, np.take(suffix, order, out=held, mode="clip"), out=suffix, mode="clip")
        suffix[:len(ends)] = ends  # end marks lead each part, in order
        np.take(block, order, out=source, mode="clip")
        new[0] = True
        np.not_equal(source[1:], source[:-1], out=new[1:])
        new[first] = True
        new[:len(ends)] = True
        new &= apart == 0
        at = np.flatnonzero(new)
        if len(at):
            parted[at] = h
            apart[at] = 1
            np.cumsum(apart, out=block)
    return suffix, parted
