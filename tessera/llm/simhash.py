"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint, padded with zeros to 69 bits, is read as three 23-bit
blocks. The anchors are the triples of codewords of the perfect binary Golay
code: every block lies within covering radius 3 of exactly one codeword. Two
fingerprints at distance d <= t have a point between them at distance
``near`` from one and ``t - near`` from the other, and the anchor of that
point is within (radius + near) and (radius + t - near) of the two. So each
fingerprint is replicated to every anchor whose blocks lie within the covering
radius plus an excess that sums to at most t - near (``near = 0`` replicates
to radius plus threshold; splitting the threshold between both sides meets at
the same anchors with a sixth of the copies). Fingerprints are compared per
anchor, all of them, by exact bit distance.

Copies cost nothing here: equal fingerprints are one row before replication.
A task reads the rows of its anchors sorted by anchor and hands on only a
spanning forest of the links it finds (at most one row per fingerprint it
read), so a dense group never becomes all its pairs. An anchor holding very
many different fingerprints is compared against itself in blocks, from a frontier of
found ones; it needs memory in proportion to its distinct fingerprints.

Edge cases. A null or wordless text has fingerprint zero and links with other
zeros and near-zeros. Repeated rows keep a row each. Null ids get a component
from the others of their class (null only if the class has no id). An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_key
from tessera.llm.components import connected_components
from tessera.session import materialize

BLOCK_BITS, BLOCKS, RADIUS = 23, 3, 3
# Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b110001110101


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class GolayAnchors:
    """Nearest codeword and codewords by excess for any 23-bit block."""

    def __init__(self, max_excess: int):
        msg = np.arange(4096, dtype=np.uint32)
        code = np.zeros(4096, dtype=np.uint32)
        for i in range(12):
            code ^= np.where((msg >> i) & 1, np.uint32(GOLAY << i), np.uint32(0))
        # Coset leaders: all error patterns of weight <= 3, by syndrome.
        bits = [1 << i for i in range(BLOCK_BITS)]
        errors = [0] + bits
        errors += [a | b for i, a in enumerate(bits) for b in bits[:i]]
        errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
        leaders = np.array(errors, dtype=np.uint32)
        self.leader = np.zeros(2048, dtype=np.uint32)
        self.leader[self.syndrome(leaders)] = leaders
        # offsets[s][e]: numbers of the codewords at excess e from a block of syndrome s,
        # relative to its nearest codeword (the code is linear).
        weight = _popcount(self.leader[:, None] ^ code[None, :])
        excess = np.maximum(weight - RADIUS, 0)
        self.starts, self.offsets = [], []
        for e in range(max_excess + 1):
            s, c = np.nonzero(excess == e)
            self.starts.append(np.searchsorted(s, np.arange(2049)))
            self.offsets.append(c.astype(np.int64))

    @staticmethod
    def syndrome(block: np.ndarray) -> np.ndarray:
        r = block.astype(np.uint32).copy()
        for i in range(BLOCK_BITS - 1, 10, -1):
            r ^= np.where((r >> np.uint32(i)) & 1, np.uint32(GOLAY << (i - 11)), np.uint32(0))
        return r.astype(np.int64)

    @staticmethod
    def number(code: np.ndarray) -> np.ndarray:
        """Message of a codeword: division by the generator, top bit first."""
        r, q = code.astype(np.uint32).copy(), np.zeros(len(code), dtype=np.int64)
        for i in range(11, -1, -1):
            bit = (r >> np.uint32(i + 11)) & 1
            q |= bit.astype(np.int64) << i
            r ^= np.where(bit, np.uint32(GOLAY << i), np.uint32(0))
        return q

    def expand(self, blocks: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, codeword number) of every codeword at excess ``e``."""
        s = self.syndrome(blocks)
        home = self.number(blocks.astype(np.uint32) ^ self.leader[s])
        n = self.starts[e][s + 1] - self.starts[e][s]
        row = np.repeat(np.arange(len(blocks)), n)
        first = np.repeat(self.starts[e][s] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return row, home[row] ^ self.offsets[e][first + np.arange(len(row))]


def anchors_of(fp: np.ndarray, excess: int, code: GolayAnchors) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within radius + ``excess`` of each fingerprint."""
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    rows, used = np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64)
    anchor = np.zeros(len(fp), dtype=np.int64)
    for b in range(BLOCKS):
        block = ((fp >> np.uint64(BLOCK_BITS * b)) & mask).astype(np.uint32)
        parts = []
        for e in range(excess + 1):
            may = np.nonzero(used + e <= excess)[0]
            r, c = code.expand(block[rows[may]], e)
            parts.append((rows[may][r], used[may][r] + e, (anchor[may][r] << 12) | c))
        rows, used, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
    return rows, anchor


def fingerprint_of(data: bytes, shingle: int) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles."""
    import xxhash
    w = data.lower().split()  # ASCII case and ASCII white space only
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    h, join = xxhash.xxh64_intdigest, b" ".join
    total, n = np.zeros(64, dtype=np.int64), len(w) - shingle + 1
    for at in range(0, n, 1 << 16):
        part = w[at:at + (1 << 16) + shingle - 1]
        v = np.array([h(join(x), 42) for x in zip(*(part[i:] for i in range(shingle)), strict=False)], dtype="<u8")
        total += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            fp = [fingerprint_of(text[i].as_buffer().to_pybytes() if text[i].is_valid else b"", shingle)
                  for i in range(len(text))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _forest(fp: np.ndarray, start: np.ndarray, size: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside the groups [start, start + size) of ``fp``."""
    small = np.nonzero((size >= 2) & (size <= 64))[0]
    for n in np.unique(size[small]):
        left, right = np.triu_indices(n, 1)
        groups = start[small[size[small] == n]]
        step = max(1, 2_000_000 // len(left))
        for g in range(0, len(groups), step):
            a = (groups[g:g + step, None] + left[None, :]).ravel()
            b = (groups[g:g + step, None] + right[None, :]).ravel()
            d = np.bitwise_count(fp[a] ^ fp[b])
            hit = d <= distance
            yield fp[a[hit]], fp[b[hit]]
    for g in np.nonzero(size > 64)[0]:
        rest = fp[start[g]:start[g] + size[g]]
        while len(rest):  # grow one cluster from a frontier; each member is visited once
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                x = frontier.pop()
                near = np.bitwise_count(rest ^ x) <= distance
                found = rest[near]
                if len(found):
                    yield np.full(len(found), x), found
                    frontier.extend(found)
                    rest = rest[~near]


class _Union:
    """Union-find over the fingerprints one task has linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), dtype=np.uint64)
        for x, y in pairs.tolist():
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def links(fps: DataFrame, distance: int = 3, near: int = 1) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that join
    exactly the fingerprints linked by chains of at most ``distance`` bits."""
    if not 0 <= near <= distance:
        raise ValueError("near must be between 0 and distance")
    excess = max(near, distance - near)
    if excess > 8:
        raise ValueError("distance too large for this code")

    def replicate(batches):
        code = GolayAnchors(excess)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at:at + 4096]
                row, anchor = anchors_of(part, excess, code)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row].view(np.int64))],
                                                 names=["anchor", "fp"])

    def compare(batches):
        union, held = _Union(), []

        def settle(anchor, fp):
            cut = np.nonzero(np.diff(anchor))[0] + 1
            start = np.concatenate(([0], cut)).astype(np.int64)
            for a, b in _forest(fp, start, np.diff(np.concatenate((start, [len(anchor)]))), distance):
                union.add(a, b)

        for b in batches:
            anchor = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(anchor):
                continue
            last = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on in the next batch
            held.append((anchor[:last], fp[:last]) if last else (anchor, fp))
            if last:
                settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = [(anchor[last:], fp[last:])]
        if held:
            settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
        found = [(x, union.root(x)) for x in list(union.up)]
        for at in range(0, len(found), 65_536):
            part = np.array([p for p in found[at:at + 65_536] if p[0] != p[1]], dtype=np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(part[:, i].copy().view(np.int64)) for i in (0, 1)],
                                             names=["a", "b"])

    at_anchors = fps.select("fp").distinct().mapInArrow(replicate, "anchor long, fp long")
    dealt = at_anchors.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id reachable
    over fingerprints that differ in ``distance`` bits or fewer."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-fingerprints")
    roots = connected_components(links(fps, distance)).select(F.col("node").alias("fp"), "root")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = materialize(classes.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` without all but the smallest id of each component. A document
    is its id and text (two 64-bit hashes): rows equal in both stay or go
    together; of rows that share an id but not the text, each stands for
    itself, the lesser hashes being the smaller. Rows with a null id stay."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("last"), F.col(f"`{id_col}`").alias("id"), *text_key(text))
    found = near_duplicates(docs.select(key.alias("doc_id"), text.alias("text")), shingle, distance)
    gone = (found.where("doc_id.id is not null and doc_id <> component_id")
            .select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, key == gone["__gone"], "left_anti")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
