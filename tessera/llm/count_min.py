"""A count-min sketch of saturating counts (0, 1, 2 or more), merged on executors.

Tasks hand on only the cells they touched, in blocks of 2^16 cells; a block's
parts are added up in a stream on one task. What reaches the driver is one bit
per cell ("two or more"), and its size is bounded by ``MAX_BITS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 2
MIN_BITS, MAX_BITS = 20, 28  # log2 of the cells of a row; 2 x 32 MB of bits at most
BLOCK = 16
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
FLUSH = 2_000_000  # hashes gathered in a task before their cells are handed on

PARTS = "row int, block int, cells binary, twice binary"


def width_bits(expected: int) -> int:
    """log2 of a row's cells: four for each expected key, within the bounds.
    Beyond the upper bound estimates grow coarser, never too low."""
    return int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(1, 4 * expected))))))


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashes * np.uint64(_MULTIPLIERS[row])) >> np.uint64(64 - bits)


def _flush(hashes: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for row in range(ROWS):
        cells, n = np.unique(_cells(hashes, row, bits).astype(np.int64), return_counts=True)
        block = cells >> BLOCK
        cut = np.concatenate(([0], np.nonzero(np.diff(block))[0] + 1, [len(block)])) if len(block) else np.array([0])
        low, twice = (cells & 0xFFFF).astype("<u2"), (n >= 2).astype(np.uint8)
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([
            pa.array([row] * len(spans), pa.int32()), pa.array([int(block[a]) for a, _ in spans], pa.int32()),
            pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([twice[a:b].tobytes() for a, b in spans], pa.binary())],
            names=["row", "block", "cells", "twice"])


def parts(hashes: Iterator[np.ndarray], bits: int, flush: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """Sketch parts of a task's stream of key hashes, ``flush`` of them at a time."""
    held, n = [], 0
    for h in hashes:
        held.append(h)
        n += len(h)
        if n >= flush:
            yield from _flush(np.concatenate(held), bits)
            held, n = [], 0
    if n:
        yield from _flush(np.concatenate(held), bits)


def merge(found: DataFrame, bits: int) -> np.ndarray:
    """Bit array (ROWS, 2^bits / 8) of the cells with a count of two or more."""
    def run(batches):
        now, count = None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()),
                 pa.array([np.packbits(count >= 2).tobytes()], pa.binary())], names=["row", "block", "bits"])

        for b in batches:
            for row, block, cells, twice in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if now != (row, block):
                    if now is not None:
                        yield done()
                    now, count = (row, block), np.zeros(1 << BLOCK, dtype=np.uint8)
                at = np.frombuffer(cells, dtype="<u2")  # a part names a cell once
                count[at] = np.minimum(count[at] + 1 + np.frombuffer(twice, dtype=np.uint8), 2)
        if now is not None:
            yield done()

    dealt = found.repartition("row", "block").sortWithinPartitions("row", "block")
    out = np.zeros((ROWS, max(1, 1 << (bits - 3))), dtype=np.uint8)
    size = 1 << (BLOCK - 3)
    for r in dealt.mapInArrow(run, "row int, block int, bits binary").collect():
        out[r["row"], r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def may_repeat(hashes: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Mask of the keys whose estimate is two or more."""
    out = np.ones(len(hashes), dtype=bool)
    for row in range(ROWS):
        cell = _cells(hashes, row, bits)
        out &= (sketch[row][cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 > 0
    return out
