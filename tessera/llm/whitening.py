"""Embedding whitening by a bidiagonal singular value solver.

Vectors are arrays of whole numbers (``quantise`` makes them), so that sums and
squared deviations are exact. The centred rows are reduced block by block: each
task folds its rows into one triangular factor R by QR, and factors are folded
in a tree of groups of ``FAN``, so a task holds a block and a few d x d factors.
The last R (d x d; as wide as a vector, whatever the number of rows) is solved
in ``bidiagonal``: its right singular vectors are the principal directions, its
squared singular values over n their variances. Nothing squares the rows, so
variances do not lose the digits that a covariance matrix would.

Centring is done on whole numbers, n * x - S, before any product. The check of
the result, the largest entry of the whitened rows' covariance minus the
identity, is centred by each block's mean and merged with the exact correction
for the difference of means.

Edge cases. A vector that is null, or holds a null or an entry that is not
finite, is dropped. Vectors have to be of one length: those of another length
than the commonest (ties: the longer) are dropped, as are empty ones. Entries
beyond +-2^40 after scaling are cut to that. Rows are fitted and returned as
often as they are given, with their id, null or not. Directions whose variance
rounding does not tell from zero (constant dimensions, fewer rows than
dimensions) are no components; where all vectors are equal there is none and
the result is empty, as for an empty table. A deviation too large for a long is
null. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bidiagonal
from tessera.session import materialize

COMPONENTS = 8
FAN = 32  # factors folded by one task
LEVELS = 3  # of the tree; FAN ** LEVELS tasks of the scan share one last fold
BLOCK_ROWS = 4096
LIMIT = 1 << 40


def quantise(vec: Column, scale: int, offset: int) -> Column:
    """Whole numbers floor(scale * entry) + offset; null for a vector that is
    null, empty, or holds a null or an entry that is not finite."""
    fine = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    cut = F.transform(vec, lambda c: (F.greatest(F.lit(-float(LIMIT)), F.least(
        F.lit(float(LIMIT)), F.floor(c.cast("double") * scale).cast("double"))).cast("long") + offset))
    return F.when(fine & (F.size(vec) > 0), cut)


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: n rows of the given sums; unit directions as columns
    and their variances, falling; the whole variance."""
    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(batches, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for start in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(start, BLOCK_ROWS)
            yield part, _matrix(part.column(at))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: 64-bit where it fits, Python integers else."""
    if not x.size:
        return x
    if n * (int(np.abs(x).max()) + int(max(abs(int(s)) for s in sums) // n) + 1) < 1 << 62:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _square_sums(dev: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; null beyond a long."""
    near = (dev.astype(np.float64) ** 2).sum(axis=1)
    if dev.dtype != object and not (near >= 9e18).any():
        return (dev * dev).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in dev.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """The rows whose vector is not null and of the commonest length."""
    rows = vectors.where(F.col(vec_col).isNotNull())
    best = rows.groupBy(F.size(vec_col).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size(vec_col) == (best["size"] if best else 0))


def _fold(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack((r, rows)), mode="r")


def _triangle(rows: DataFrame, vec_col: str, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows."""
    d = len(sums)

    def scan(batches):
        from pyspark import TaskContext
        r = None
        for _, x in _blocks(batches, 0):
            r = _fold(r, _deviations(x, n, sums).astype(np.float64) / n)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def merge(batches):
        held = {}  # few groups a task: neighbours lie together
        for b in batches:
            for group, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[group] = _fold(held.get(group), np.frombuffer(raw).reshape(-1, d))
        for group, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                                             names=["part", "r"])

    found = rows.select(vec_col).mapInArrow(scan, "part long, r binary")
    for _ in range(LEVELS):
        up = found.select(F.floor(F.col("part") / FAN).cast("long").alias("part"), "r")
        found = up.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part long, r binary")
    r = None
    for row in found.toLocalIterator():  # one factor for FAN ** LEVELS tasks of the scan
        r = _fold(r, np.frombuffer(row["r"]).reshape(-1, d))
    return r if r.shape[0] == d else np.vstack((r, np.zeros((d - r.shape[0], d))))


def fit(rows: DataFrame, vec_col: str, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of ``rows`` (of ``usable``); null if there are none."""
    def part(n, sums):
        d = len(sums)
        return pa.RecordBatch.from_arrays([pa.array(np.full(d, n)), pa.array(np.arange(d, dtype=np.int32)),
                                           pa.array(sums)], names=["n", "dim", "s"])

    def scan(batches):
        n, sums = 0, None
        for _, x in _blocks(batches, 0):
            n, sums = n + len(x), x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
            if n >= 1 << 20:  # entries of up to LIMIT cannot overflow before
                yield part(n, sums)
                n, sums = 0, None
        if n:
            yield part(n, sums)

    parts = rows.select(vec_col).mapInArrow(scan, "n long, dim int, s long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not found:
        return None
    n = found[0]["n"]
    sums = np.array([int(r["s"]) for r in sorted(found, key=lambda r: r["dim"])], dtype=object)
    r = _triangle(rows, vec_col, n, sums)
    squares, directions = bidiagonal.right_singular(r, components)
    return Whitening(n, sums, directions, squares[:directions.shape[1]] / n, float(np.sum(r * r)) / n)


def _whiten(model: Whitening, dev: np.ndarray) -> np.ndarray:
    return (dev.astype(np.float64) / model.n) @ (model.directions / np.sqrt(model.variances))


def identity_error(rows: DataFrame, vec_col: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(model.variances)

    def merged(a, b):
        if a is None:
            return b
        n, mean, m2 = a[0] + b[0], a[1], a[2]
        step = b[1] - mean
        return n, mean + step * (b[0] / n), m2 + b[2] + np.outer(step, step) * (a[0] * b[0] / n)

    def scan(batches):
        now = None
        for _, x in _blocks(batches, 0):
            w = _whiten(model, _deviations(x, model.n, model.sums))
            mean = w.mean(axis=0)
            now = merged(now, (len(w), mean, (w - mean).T @ (w - mean)))
        if now is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int64()), pa.array([now[1].tobytes()], pa.binary()),
                 pa.array([now[2].tobytes()], pa.binary())], names=["n", "mean", "m2"])

    now = None
    for r in rows.select(vec_col).mapInArrow(scan, "n long, mean binary, m2 binary").toLocalIterator():
        now = merged(now, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"]).reshape(k, k)))
    return float(np.abs(now[2] / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str, vec_col: str, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of
    every usable row and component; the id keeps its name. The vectors are
    written once, as they are read five times."""
    rows = usable(materialize(vectors.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{vec_col}`").alias(vec_col))
                              .where(F.col(vec_col).isNotNull()), "whitening-vectors"), vec_col)
    id_type = dict(vectors.dtypes)[id_col]
    schema = (f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    model = fit(rows, vec_col, components)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, vec_col, model), len(model.variances)
    explained = model.variances / model.total

    def run(batches):
        for part, x in _blocks(batches, 1):
            m, dev = len(x), _deviations(x, model.n, model.sums)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), pa.array(_square_sums(dev), pa.int64()).take(pa.array(at)),
                 pa.array(_whiten(model, dev).ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(f"`{id_col}`", f"`{vec_col}`").mapInArrow(run, schema)
