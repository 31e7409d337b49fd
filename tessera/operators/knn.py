"""Exact similarity top-k (vector search) as a Spark job.

Corpus rows are cut into cells around sampled rows (the centres), each with the
radius that holds its rows. A score q.x is at most q.c + |q| r for every x of a
cell with centre c and radius r, and at least q.c - |q| r. So each query gets a
floor that its k-th score cannot lie below, from its scores with the centres
(they are corpus rows) and from the cells whose lower bounds hold k rows; cells
whose upper bound lies below the floor are never scored for it. On vectors
without clusters no cell can be left out and all pairs are scored.

* Neither side passes through the driver. It sees the centres, whose bytes are
  bounded by ``CENTRE_BYTES``, a radius and a count for each, and for each slice
  of queries a bit for each cell.
* Queries are sliced by matching columns and nearest centres. A task holds one
  slice with its best rows so far, and the corpus passes by, cell by cell, read
  from where it was written: no row of either side is copied for another slice
  or cell, so disk grows with the rows, not with the pairs. Cells that no query
  of the slice needs are not read; a query leaves out more cells as its k-th
  score grows. Few queries meet a large corpus in several tasks, dealt by row
  number.
* A query never meets a corpus row with another value in a matching column.
* A task emits at most ``k`` rows per query. The global top-k is a
  ``row_number`` window over those candidates (Spark plans it with
  ``WindowGroupLimit``), shuffled by query id only.

Both sides are written once with their cells. Repeated query rows are one
query. Rows without a vector or with a null in a matching column take no part.
"""

from __future__ import annotations

import math

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, settings

DEFAULT_BLOCK_BYTES = 8 * 1024 * 1024    # vectors of one part of a cell or slice
CELL_ROWS = 512                          # corpus rows for each centre, while centres are few (2 sqrt(n) at most)
KEY_COUNTS = 1 << 20                     # counts of rows by cell and matching columns that the driver sees
CENTRE_BYTES = 32 * 1024 * 1024          # of all centres together
MARGIN = 1e-9                            # bounds and scores are rounded apart from each other
SCORE_CELLS = 4 * 1024 * 1024            # score-matrix cells held at once per task
PLAN_CELLS = 1024 * 1024                 # scores of rows with centres held at once per task
SLICE_PARTS = 4                          # a slice of queries has the bytes of so many parts
TASK_ROWS = 4096                         # rows of a side that are worth a task of their own
TASKS_AT_ONCE = 64                       # slices in one plan, or as many as there are cores
SCORE_DECIMALS = 12  # matrix products of equal vectors can differ in the last bit; ties must stay ties


def _as_matrix(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in col.values])


def _topk_merge(best_s, best_i, s, ids, k):
    """Merge candidate scores ``s`` (q x n, ids) into the running top-k."""
    if best_s is None:
        all_s, all_i = s, np.broadcast_to(ids, s.shape)
    else:
        all_s = np.concatenate([best_s, s], axis=1)
        all_i = np.concatenate([best_i, np.broadcast_to(ids, s.shape)], axis=1)
    n = all_s.shape[1]
    if n > k:
        # deterministic cut: highest score, then smallest id; only scores of at
        # least the k-th are sorted, ties of the k-th included
        low = np.nan_to_num(all_s, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        kth = np.partition(low, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(low >= kth[:, None])
        order = np.lexsort((all_i[row, col], -low[row, col], row))
        row, col = row[order], col[order]
        begin = np.searchsorted(row, np.arange(len(low)))
        cut = col[begin[:, None] + np.arange(k)[None, :]]
        all_s = np.take_along_axis(low, cut, axis=1)
        all_i = np.take_along_axis(all_i, cut, axis=1)
    return np.ascontiguousarray(all_s), np.ascontiguousarray(all_i)


def _unit(mat: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(mat, axis=1)
    norm[norm == 0] = np.inf
    return mat / norm[:, None]


class _Least:
    """Stands for a null id: below all others, as Spark sorts it."""

    def __lt__(self, other):
        return not isinstance(other, _Least)

    def __gt__(self, other):
        return False

    def __eq__(self, other):
        return isinstance(other, _Least)

    __hash__ = object.__hash__


def _ids(col: pa.Array) -> np.ndarray:
    if col.null_count == 0 and (pa.types.is_integer(col.type) or pa.types.is_floating(col.type)):
        return col.to_numpy(zero_copy_only=False)
    out = np.empty(len(col), dtype=object)
    out[:] = [_Least() if v is None else v for v in col.to_pylist()]
    return out


def _arrow_matrix(col: pa.Array) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    sizes = np.unique(col.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.min()} and {sizes.max()}")
    return col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(col), sizes[0])


def _keys_of(batch: pa.RecordBatch, n_keys: int) -> list[tuple]:
    cols = [batch.column(f"_k{i}").to_pylist() for i in range(n_keys)]
    return [tuple(tuple(x) if isinstance(x, list) else x for x in row) for row in zip(*cols, strict=True)]


class _Slice:
    """Queries of one slice and the best rows they have met so far."""

    def __init__(self, queries: pa.Table, k, exclude_self, normalize, n_keys, centres, radii):
        self.k, self.exclude_self, self.normalize, self.n_keys = k, exclude_self, normalize, n_keys
        self.centres, self.radii = centres, radii
        queries = queries.combine_chunks()
        batch = queries.to_batches()[0]
        self.qids, self.own = batch.column("_qid"), _ids(batch.column("_qid"))
        mat = _arrow_matrix(batch.column("_vec"))
        self.mat = _unit(mat) if normalize else mat
        self.size = np.linalg.norm(self.mat, axis=1)
        slack = MARGIN * (1 + self.size)
        self.floor = batch.column("_floor").to_numpy(zero_copy_only=False) - slack
        self.groups: dict[tuple, np.ndarray] = {}
        if n_keys:
            for i, key in enumerate(_keys_of(batch, n_keys)):
                self.groups.setdefault(key, []).append(i)
            self.groups = {key: np.array(rows) for key, rows in self.groups.items()}
        self.all = np.arange(len(mat))
        self.best = np.full((len(mat), k), -np.inf)
        self.ids: np.ndarray | None = None
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_found = 0

    def meet(self, batch: pa.RecordBatch) -> None:
        """Corpus rows: runs of one cell (and one value of the matching columns)."""
        cells = batch.column("_cell").to_numpy()
        mat = _arrow_matrix(batch.column("_vec"))
        mat = _unit(mat) if self.normalize else mat
        ids = _ids(batch.column("_did"))
        new = np.flatnonzero(np.diff(cells)) + 1
        keys = None
        if self.n_keys:
            keys = _keys_of(batch, self.n_keys)
            new = np.union1d(new, [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]).astype(np.int64)
        for a, b in zip([0, *new], [*new, len(cells)], strict=True):
            rows = self.all if keys is None else self.groups.get(keys[a])
            if rows is not None:
                self._score(int(cells[a]), rows, mat[a:b], ids[a:b])

    def _score(self, cell: int, rows: np.ndarray, mat: np.ndarray, ids: np.ndarray) -> None:
        own = self.mat if rows is self.all else self.mat[rows]
        high = own @ self.centres[cell] + self.size[rows] * self.radii[cell]
        may = ~(high < self.floor[rows])
        if not may.all():
            rows, own = rows[may], own[may]
        step = max(1, SCORE_CELLS // len(mat))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            scores = own[at:at + step] @ mat.T
            row, col = np.nonzero(scores >= self.floor[some][:, None])
            if len(row) > 4 * self.k * len(some):   # no floor yet: only the best of these
                scores = np.round(scores, SCORE_DECIMALS)
                if self.exclude_self:
                    scores = np.where(self.own[some][:, None] == ids[None, :], -np.inf, scores)
                place = np.broadcast_to(np.arange(len(ids)), scores.shape)
                # by score, then id: places in the order of the ids
                order = np.lexsort((ids,))
                score, place = _topk_merge(None, None, scores[:, order], place[0], self.k)
                row, col = np.nonzero(np.isfinite(score))
                score, col = score[row, col], order[place[row, col]]
            else:
                score = np.round(scores[row, col], SCORE_DECIMALS)
                keep = np.isfinite(score)
                if self.exclude_self:
                    keep &= ~(self.own[some[row]] == ids[col]).astype(bool)
                row, col, score = row[keep], col[keep], score[keep]
            if len(row):
                self.found.append((some[row], score, ids[col]))
                self.n_found += len(row)
        if self.n_found > self.best.size // 2 + SCORE_CELLS // 16 or self.n_found and self.ids is None:
            self._merge()

    def _merge(self) -> None:
        row, score, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found, self.n_found = [], 0
        if self.ids is None:
            self.ids = np.empty(self.best.shape, dtype=ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(object)
        met = np.unique(row)
        held, place = np.nonzero(np.isfinite(self.best[met]))
        held = met[held]
        row = np.concatenate([held, row])
        score = np.concatenate([self.best[held, place], score])
        ids = np.concatenate([self.ids[held, place], ids])
        order = np.lexsort((ids, -score, row))   # highest score, then smallest id
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < self.k
        row, place = row[top], place[top]
        self.best[row, place], self.ids[row, place] = score[top], ids[top]
        # rounded scores of at least the k-th go on, ties included
        self.floor[met] = np.maximum(self.floor[met], self.best[met, self.k - 1] - 2 * 10.0 ** -SCORE_DECIMALS)

    def result(self, id_type: pa.DataType):
        if self.found:
            self._merge()
        row, place = np.nonzero(np.isfinite(self.best))
        for at in range(0, len(row), 1 << 16):
            r, p = row[at:at + (1 << 16)], place[at:at + (1 << 16)]
            ids = self.ids[r, p]
            if ids.dtype == object:
                ids = [None if isinstance(v, _Least) else v for v in ids]
            yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(r)), pa.array(ids, type=id_type),
                                              pa.array(self.best[r, p])], ["query_id", "doc_id", "score"])


def _make_scorer(counts: dict[int, int], *args):
    """Scores the rows of one task: the queries of a slice, then corpus rows."""
    def score(batches):
        queries, early, held = [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            asks = b.column("_cell").to_numpy() < 0
            if asks.any():
                queries.append(b.filter(pa.array(asks)))
            if not asks.all():
                early.append(b.filter(pa.array(~asks)))
            # Queries are read first; where a scheduler has it otherwise, the corpus rows wait.
            if held is None and queries and sum(x.num_rows for x in queries) == counts[queries[0].column("_slice")[0].as_py()]:
                held, queries = _Slice(pa.Table.from_batches(queries), *args), []
            if held is not None:
                for rows in early:
                    held.meet(rows)
                id_type, early = b.schema.field("_did").type, []
        if queries:
            raise RuntimeError("queries of a slice are missing")
        if held is not None:
            yield from held.result(id_type)
    return score


def _side(df: DataFrame, row_id: str, vec: str, keys: tuple[str, ...], name: str) -> DataFrame:
    """(name, _vec, _k0 ..): the rows that can take part."""
    cols = [F.col(row_id).alias(name), F.col(vec).alias("_vec"),
            *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]]
    return df.select(*cols).dropna(subset=["_vec", *[f"_k{i}" for i in range(len(keys))]])


class _Cells:
    """Centres with the radii and counts of their cells."""

    def __init__(self, centres: np.ndarray, ids: np.ndarray, keys: np.ndarray):
        self.centres, self.ids, self.keys = centres, ids, keys
        self.norms = (centres ** 2).sum(axis=1)
        self.radii = self.counts = self.parts = None
        self.of_key: dict[int, tuple[np.ndarray, np.ndarray]] | None = None  # (cells, counts) of a key's rows

    def nearest(self, mat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its centre, scores with all centres)."""
        scores = mat @ self.centres.T
        cell = np.argmin(np.nan_to_num(self.norms[None, :] - 2 * scores, nan=np.inf), axis=1)
        return cell, np.linalg.norm(mat - self.centres[cell], axis=1), scores

    def slices(self, asking: np.ndarray, per_part: int) -> tuple[np.ndarray, np.ndarray]:
        """(parts, first number) of the slices of the queries of each cell.
        Cells with few queries share a slice with others, taken in order of
        their score with the first centre; those with many are cut."""
        # A query meets the cells it needs whatever slice it is in, so large
        # slices only make groups fewer.
        most = max(CELL_ROWS, per_part // 2)
        parts = np.maximum(1, -(-asking // per_part))
        first, number, held = np.zeros(len(asking), dtype=np.int64), 0, 0
        for cell in np.argsort(-(self.centres @ self.centres[0]), kind="stable"):
            if held and held + asking[cell] > max(most, asking[cell]):
                number, held = number + 1, 0
            first[cell], held = number, held + asking[cell]
            if parts[cell] > 1 or held >= most:
                number, held = number + parts[cell], 0
        return parts, first

    def floors(self, mat, scores, ids, keys, k, exclude_self, most_rows) -> np.ndarray:
        """What the k-th score of each query cannot lie below."""
        size = np.linalg.norm(mat, axis=1)[:, None]
        reach = size * self.radii[None, :]
        floor = np.full(len(mat), -np.inf)
        # Centres that the query may see are rows of the corpus.
        seen = np.where(self.keys[None, :] == keys[:, None], scores, -np.inf)
        if exclude_self:
            seen = np.where(self.ids[None, :] == ids[:, None], -np.inf, seen)
        if seen.shape[1] >= k:
            floor = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k]
        if most_rows is None:
            return floor
        for rows, counts in self._counts(keys):
            # Cells by falling lower bound, until they hold enough rows.
            low = scores[rows] - reach[rows]
            order = np.argsort(-low, axis=1)
            enough = np.cumsum(counts[order], axis=1) >= k + most_rows
            at = np.argmax(enough, axis=1)
            own = np.arange(len(rows))
            floor[rows] = np.maximum(floor[rows], np.where(enough[own, at], low[own, order[own, at]], -np.inf))
        return floor

    def _counts(self, keys):
        """(queries, counts of the cells' rows that they may see) by matching columns."""
        if self.of_key is None:
            yield np.arange(len(keys)), self.counts
            return
        for key in np.unique(keys):
            counts = np.zeros(len(self.centres), dtype=np.int64)
            if key in self.of_key:
                counts[self.of_key[key][0]] = self.of_key[key][1]
            yield np.flatnonzero(keys == key), counts

    def needed(self, mat, scores, keys, floor) -> np.ndarray:
        """Mask (query, cell) of the cells that may hold a row of the top k."""
        size = np.linalg.norm(mat, axis=1)[:, None]
        need = np.zeros(scores.shape, dtype=bool)
        for rows, counts in self._counts(keys):
            high = scores[rows] + size[rows] * self.radii[None, :]
            need[rows] = ~(high < floor[rows, None] - MARGIN * (1 + size[rows])) & (counts[None, :] > 0)
        return need


def _hash(cols: list[str]) -> Column:
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def _vectors(col: pd.Series, normalize: bool) -> np.ndarray:
    return _unit(_as_matrix(col)) if normalize else _as_matrix(col)


def _centres(d: DataFrame, keys: list[str], n_rows: int, width: int, normalize: bool) -> _Cells:
    """Sampled corpus rows: those of least hash, the same at every run."""
    count = max(1, min(-(-n_rows // CELL_ROWS), 2 * math.isqrt(n_rows), CENTRE_BYTES // (8 * max(1, width))))
    sane = d.where(F.forall("_vec", lambda c: c.isNotNull() & ~F.isnan(c)))
    order = F.xxhash64(F.col("_vec"), F.col("_did"))
    rows = (sane.select("_vec", F.xxhash64("_did").alias("i"), _hash(keys).alias("k"), order.alias("o"))
            .orderBy("o", "i").limit(count).collect())
    if not rows:  # nothing that could be scored
        return _Cells(np.zeros((1, width)), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    mat = _vectors(pd.Series([r["_vec"] for r in rows]), normalize)
    return _Cells(mat, np.array([r["i"] for r in rows], dtype=np.int64), np.array([r["k"] for r in rows], dtype=np.int64))


def _first_copies(d: DataFrame, keys: list[str], k: int, exclude_self: bool) -> DataFrame:
    """Corpus rows that some query may return. Copies of a vector have equal
    scores, so of those of one key only the least ids count: k, and those that
    may stand under a query's own id. Only hashes are counted; vectors move
    only where a hash stands more often than that."""
    h = F.xxhash64("_vec", *keys)
    own = d.groupBy("_did").count().agg(F.max("count")).first()[0] or 0 if exclude_self else 0
    often = materialize(d.groupBy(h.alias("_h")).count().where(F.col("count") > k + own).select("_h"), "knn-copies")
    if often.isEmpty():
        return d
    marked = d.withColumn("_h", h)
    place = Window.partitionBy("_h", *keys, "_vec").orderBy("_did")
    copies = (marked.join(often, "_h", "left_semi").withColumn("_place", F.row_number().over(place))
              .where(F.col("_place") <= k + own))
    return materialize(marked.join(often, "_h", "left_anti").unionByName(copies.drop("_place")).drop("_h"), "knn-copies")


def _lookup(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)


def _distinct(q: DataFrame) -> DataFrame:
    """Query rows, each once. Only hashes are counted; rows move only where a
    hash stands more than once."""
    h = F.xxhash64(*q.columns)
    often = materialize(q.groupBy(h.alias("_h")).count().where("count > 1").select("_h"), "knn-repeated")
    if often.isEmpty():
        return q
    marked = q.withColumn("_h", h)
    once = marked.join(often, "_h", "left_semi").dropDuplicates()
    return materialize(marked.join(often, "_h", "left_anti").unionByName(once).drop("_h"), "knn-asked")


def _place(queries, corpus, k, query_id, query_vec, doc_id, doc_vec, match_cols, exclude_self, metric, block_bytes):
    """(query rows, corpus rows with their cells, cells, most rows under one id,
    rows of a part, slices, parts). The corpus is written by part, matching
    columns and cell, so that the rows of a cell lie together."""
    q = _distinct(_side(queries, query_id, query_vec, match_cols, "_qid"))
    d = _side(corpus, doc_id, doc_vec, match_cols, "_did")
    keys, normalize = [f"_k{i}" for i in range(len(match_cols))], metric == "cosine"
    d = _first_copies(d, keys, k, exclude_self)
    n_d, width = d.agg(F.count("*"), F.max(F.size("_vec"))).first()
    per_part = max(1, block_bytes // (8 * (width or 0) + 64))
    cores = d.sparkSession.sparkContext.defaultParallelism
    n_q, most = q.count(), max(CELL_ROWS, SLICE_PARTS * per_part)
    slices = max(1, -(-n_q // most), min(cores, n_q // max(CELL_ROWS, min(TASK_ROWS, most))))
    slices = -(-slices // cores) * cores if slices > cores else slices
    parts = max(1, min(-(-cores // slices), n_d // TASK_ROWS))
    cells = _centres(d, keys, n_d, width or 0, normalize)
    at_once = max(1, PLAN_CELLS // len(cells.centres))

    def assign(batches):
        for b in batches:
            for start in range(0, len(b), at_once):
                part = b.iloc[start:start + at_once]
                cell, far, _ = cells.nearest(_vectors(part["_vec"], normalize))
                yield part.assign(_cell=cell.astype(np.int32), _far=np.nan_to_num(far))

    numbered = d.withColumn("_no", F.monotonically_increasing_id()).withColumn("_kh", _hash(keys))
    order = ["_part", "_kh", "_cell"]
    placed = numbered.mapInPandas(assign, T.StructType([*numbered.schema.fields, T.StructField(
        "_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])).withColumn(
            "_part", F.pmod(F.xxhash64("_no"), F.lit(parts)).cast("int"))
    placed = materialize(placed.repartitionByRange(*order, "_no").sortWithinPartitions(*order), "knn-corpus")
    cells.radii, cells.counts = np.zeros(len(cells.centres)), np.zeros(len(cells.centres), dtype=np.int64)
    for r in placed.groupBy("_cell").agg(F.max("_far").alias("far"), F.count("*").alias("n")).collect():
        cells.radii[r["_cell"]], cells.counts[r["_cell"]] = r["far"] * (1 + MARGIN), r["n"]
    if keys:
        by_key = placed.groupBy("_cell", "_kh").count()
        seen = by_key.limit(KEY_COUNTS + 1).collect()
        if len(seen) <= KEY_COUNTS:
            found: dict[int, tuple[list, list]] = {}
            for r in seen:
                at, counts = found.setdefault(r["_kh"], ([], []))
                at.append(r["_cell"])
                counts.append(r["count"])
            cells.of_key = {key: (np.array(at), np.array(counts)) for key, (at, counts) in found.items()}
    # Rows that a query may not count: those under its own id. Where it is not
    # known how many rows of a cell match, counts are left open.
    most_rows = None
    if not keys or cells.of_key is not None:
        most_rows = (placed.groupBy("_did").count().agg(F.max("count")).first()[0] or 0) if exclude_self else 0
    return q, placed, cells, most_rows, per_part, slices, parts


def _floored(q: DataFrame, keys: list[str], cells: _Cells, k: int, exclude_self: bool, most_rows, normalize: bool,
             with_cells: bool = False) -> DataFrame:
    """Queries with their nearest centre ``_own``, the floor of their k-th score
    and, if asked for, the cells that they need."""
    at_once = max(1, PLAN_CELLS // len(cells.centres))

    def plan(batches):
        for b in batches:
            for start in range(0, len(b), at_once):
                part = b.iloc[start:start + at_once]
                mat, kh = _vectors(part["_vec"], normalize), part["_kh"].to_numpy()
                near, _, scores = cells.nearest(mat)
                floor = cells.floors(mat, scores, part["_qh"].to_numpy(), kh, k, exclude_self, most_rows)
                out = part.drop(columns=["_qh"]).assign(_own=near.astype(np.int32), _floor=floor)
                if with_cells:
                    out["_cells"] = [np.flatnonzero(row).astype(np.int32) for row in cells.needed(mat, scores, kh, floor)]
                yield out

    hashed = q.withColumn("_kh", _hash(keys)).withColumn("_qh", F.xxhash64("_qid"))
    more = [T.StructField("_own", T.IntegerType()), T.StructField("_floor", T.DoubleType()),
            *[T.StructField("_cells", T.ArrayType(T.IntegerType()))] * with_cells]
    return hashed.mapInPandas(plan, T.StructType([f for f in hashed.schema.fields if f.name != "_qh"] + more))


def block_plan(queries: DataFrame, corpus: DataFrame, k: int = 10, *,
               query_id: str = "query_id", query_vec: str = "vector", doc_id: str = "id", doc_vec: str = "vector",
               match_cols: tuple[str, ...] = (), exclude_self: bool = False, metric: str = "cosine",
               block_bytes: int = DEFAULT_BLOCK_BYTES) -> tuple[DataFrame, DataFrame, list[str]]:
    """(query rows, corpus rows, group key) of the pairs that are scored at
    most, to look at a plan: a query stands in each group whose cell it needs."""
    q, placed, cells, most_rows, per_part, _, _ = _place(queries, corpus, k, query_id, query_vec, doc_id, doc_vec,
                                                         match_cols, exclude_self, metric, block_bytes)
    keys, cells.parts = [f"_k{i}" for i in range(len(match_cols))], np.maximum(1, -(-cells.counts // per_part))
    planned = materialize(_floored(q.withColumn("_no", F.monotonically_increasing_id()), keys, cells, k, exclude_self,
                                   most_rows, metric == "cosine", with_cells=True), "knn-queries")
    asking = np.zeros(len(cells.centres), dtype=np.int64)
    for r in planned.groupBy("_own").count().collect():
        asking[r["_own"]] = r["count"]
    slices, first = cells.slices(asking, per_part)

    def deal(cell, counts):
        return F.pmod(F.xxhash64("_no"), _lookup(counts, F.col(cell))).cast("int")

    left = (planned.withColumn("_slice", deal("_own", slices) + _lookup(first, F.col("_own")))
            .withColumn("_cell", F.explode("_cells"))
            .withColumn("_part", F.explode(F.sequence(F.lit(0), (_lookup(cells.parts, F.col("_cell")) - 1).cast("int")))))
    group = ["_slice", "_cell", "_part"]
    met = left.select(*(F.col(c).alias(c) for c in group)).distinct()
    right = placed.withColumn("_part", deal("_cell", cells.parts)).join(met, ["_cell", "_part"])
    return (left.select("_qid", "_vec", *group, *keys), right.select("_did", "_vec", *group, *keys), [*group, *keys])


def _sliced(q: DataFrame, keys: list[str], cells: _Cells, slices: int, normalize: bool, *args) -> tuple[DataFrame, list]:
    """(queries with their range, for each slice: first and last range, rows,
    least and greatest hash of the matching columns, mask of the cells it needs).
    A slice is made of ranges that lie side by side, where there are more of them."""
    asked = _floored(q, keys, cells, *args, normalize)
    if slices > 1:
        order = np.empty(len(cells.centres), dtype=np.int32)   # centres by their score with the first
        order[np.argsort(-(cells.centres @ cells.centres[0]), kind="stable")] = np.arange(len(order))
        lie = _lookup(order, F.col("_own")) if len(order) <= 1 << 10 else F.col("_own")
        asked = asked.repartitionByRange(slices, F.col("_kh"), lie, F.xxhash64("_qid"), F.xxhash64("_vec"))
        asked = asked.withColumn("_slice", F.spark_partition_id())
    else:
        asked = asked.withColumn("_slice", F.lit(0))
    asked = materialize(asked, "knn-queries")
    at_once = max(1, PLAN_CELLS // len(cells.centres))

    def meet(batches):
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            for start in range(0, len(b), at_once):
                part = b.iloc[start:start + at_once]
                mat, of = _vectors(part["_vec"], normalize), part["_slice"].to_numpy()
                need = cells.needed(mat, cells.nearest(mat)[2], part["_kh"].to_numpy(), part["_floor"].to_numpy())
                for i in np.unique(of):
                    here = need[of == i].any(axis=0)
                    bits[i] = bits[i] | here if i in bits else here
        yield pd.DataFrame({"_slice": list(bits), "bits": [np.packbits(x).tobytes() for x in bits.values()]})

    met = asked.mapInPandas(meet, "_slice int, bits binary").groupBy("_slice").agg(F.collect_set("bits").alias("bits"))
    held = asked.groupBy("_slice").agg(F.count("*").alias("n"), F.min("_kh").alias("low"), F.max("_kh").alias("high"))
    found, rows = [], sorted(held.join(met, "_slice").collect(), key=lambda r: r["_slice"])
    share = -(-sum(r["n"] for r in rows) // slices)
    for r in rows:
        bits = reduce(np.bitwise_or, [np.frombuffer(bytes(x), dtype=np.uint8) for x in r["bits"]])
        need = np.unpackbits(bits, count=len(cells.centres)).astype(bool)
        own = (r["_slice"], r["_slice"], r["n"], r["low"], r["high"], need)
        if found and found[-1][2] + r["n"] <= share:
            first, _, n, low, high, more = found.pop()
            own = (first, r["_slice"], n + r["n"], min(low, r["low"]), max(high, r["high"]), more | need)
        found.append(own)
    return asked, found


def similarity_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, *,
                    query_id: str = "query_id", query_vec: str = "vector",
                    doc_id: str = "id", doc_vec: str = "vector",
                    match_cols: tuple[str, ...] = (), exclude_self: bool = False,
                    metric: str = "cosine", block_bytes: int = DEFAULT_BLOCK_BYTES) -> DataFrame:
    """Top-k corpus rows per query by cosine (or dot) similarity.

    ``match_cols``: per-query equality filters; a query only sees corpus rows
    whose columns equal its own (the batch form of a metadata pre-filter).
    ``block_bytes`` bounds the vectors of a part on average; a result does not
    depend on it. Returns ``(query_id, rank, doc_id, score)`` with the caller's
    id names.
    """
    keys, normalize = [f"_k{i}" for i in range(len(match_cols))], metric == "cosine"
    q, placed, cells, most_rows, _, slices, parts = _place(queries, corpus, k, query_id, query_vec, doc_id, doc_vec,
                                                           match_cols, exclude_self, metric, block_bytes)
    asked, met = _sliced(q, keys, cells, slices, normalize, k, exclude_self, most_rows)
    vec = F.col("_vec")
    if queries.schema[query_vec].dataType != corpus.schema[doc_vec].dataType:
        vec = vec.cast("array<double>")
    own_type, id_type = queries.schema[query_id].dataType, corpus.schema[doc_id].dataType
    tasks = []
    for i, last, _, low, high, need in met:
        left = asked.where(F.col("_slice").between(i, last)).select(
            F.lit(i).alias("_slice"), F.lit(-1).alias("_cell"), "_qid", F.lit(None).cast(id_type).alias("_did"), vec.alias("_vec"),
            "_floor", *keys)
        right = placed if need[cells.counts > 0].all() else placed.where(F.col("_cell").isin(np.flatnonzero(need).tolist()))
        if keys:
            right = right.where(F.col("_kh").between(low, high))
        right = right.select(F.lit(i).alias("_slice"), "_cell", F.lit(None).cast(own_type).alias("_qid"), "_did",
                             vec.alias("_vec"), F.lit(None).cast("double").alias("_floor"), *keys, "_part")
        for j in range(parts):
            # one task: first the slice, then the corpus, read one after the other
            tasks.append(left.unionByName(right.where(F.col("_part") == j).drop("_part")).coalesce(1))
    out_schema = T.StructType([T.StructField("query_id", own_type), T.StructField("doc_id", id_type),
                               T.StructField("score", T.DoubleType())])
    if not tasks:
        return _finish(q.sparkSession.createDataFrame([], out_schema), k, query_id, doc_id)
    scorer = _make_scorer({i: n for i, _, n, *_ in met}, k, exclude_self, normalize, len(keys), cells.centres, cells.radii)
    at_once, cands = max(TASKS_AT_ONCE, q.sparkSession.sparkContext.defaultParallelism), []
    # Spark 4.1 would make one task of a union of single tasks.
    with settings(q.sparkSession, {"spark.sql.unionOutputPartitioning": "false"}):
        for start in range(0, len(tasks), at_once):
            some = reduce(DataFrame.unionByName, tasks[start:start + at_once])
            cands.append(materialize(some.mapInArrow(scorer, out_schema), "knn-candidates"))
    return _finish(reduce(DataFrame.unionByName, cands), k, query_id, doc_id)


def _finish(cand: DataFrame, k: int, query_id: str, doc_id: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return (cand.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select(F.col("query_id").alias(query_id), "rank",
                    F.col("doc_id").alias(doc_id), "score"))
