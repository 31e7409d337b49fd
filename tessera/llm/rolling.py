"""Window hashes over concatenated sequences, as whole-array operations.

A sequence is an array of 64-bit element hashes. Arithmetic wraps modulo 2^64
on purpose; element hashes are pseudo-random, so two different windows have
equal hashes with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np

GRAM_BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that their order is as good as random."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def window_hash(ids: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of ``length`` elements, by binary doubling."""
    if len(ids) < length:
        return np.empty(0, dtype=np.uint64)
    out, done, have, power, size = None, 0, ids, base, 1
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if out is None:
                    out, done = have, size
                else:
                    n = len(ids) - done - size + 1
                    out = out[:n] * power + have[done:done + n]
                    done += size
            size *= 2
            if size > length:
                return mix(out[:len(ids) - length + 1])
            have = have[:len(have) - size // 2] * power + have[size // 2:]
            power = power * power


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return op(x[:len(x) - rest], x[rest:]) if rest else x


class Windows:
    """Windows of ``length`` elements over several sequences laid end to end.

    ``valid`` marks the starts whose window stays in its sequence. ``key`` is
    the window's minimizer: the least hash of its grams of ``gram`` elements,
    so equal windows have equal keys, and neighbouring windows share them."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, length: int, gram: int):
        """starts: first element of each sequence, then the total length."""
        n = max(0, len(ids) - length + 1)
        self.length, self.gram, self.n = length, gram, n
        left = starts[1:] - starts[:-1] - length + 1  # windows of each sequence
        edge = np.zeros(len(ids) + 1, dtype=np.int32)
        has = left > 0
        np.add.at(edge, starts[:-1][has], 1)
        np.add.at(edge, starts[:-1][has] + left[has], -1)
        self.valid = np.cumsum(edge)[:n] > 0
        self.grams = window_hash(ids, gram, GRAM_BASE)
        self.key = sliding(self.grams, length - gram + 1, np.minimum) if n else np.empty(0, dtype=np.uint64)

    def selected(self) -> np.ndarray:
        """Hashes of the grams that are the minimizer of some valid window,
        one for every place where such a gram stands."""
        if not self.n:
            return np.empty(0, dtype=np.uint64)
        span = self.length - self.gram  # a gram at p is in windows p - span .. p
        key = np.where(self.valid, self.key, np.uint64(0))
        pad = np.zeros(span, dtype=np.uint64)
        top = sliding(np.concatenate([pad, key, pad]), span + 1, np.maximum)
        return self.grams[(self.grams == top) & (top > 0)]

    def runs(self, chosen: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the maximal runs of chosen windows of one sequence
        that share a key."""
        if not self.n:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        chosen = chosen & self.valid
        cut = np.ones(self.n, dtype=bool)  # no run goes on over these windows
        np.not_equal(self.key[1:], self.key[:-1], out=cut[1:])
        cut[1:] |= ~chosen[:-1]
        cut[starts[starts < self.n]] = True
        cut |= ~chosen
        at = np.flatnonzero(cut)
        end = np.append(at[1:], self.n)
        is_run = chosen[at]
        return at[is_run], end[is_run]


def cover(flagged: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the ``n`` elements that lie in a window starting at ``flagged``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, flagged, 1)
    np.add.at(edge, np.minimum(flagged + length, n), -1)
    return np.cumsum(edge)[:n] > 0
