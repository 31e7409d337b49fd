"""Suffix-array dedup: bytes in strings of ``length`` bytes that also start earlier go.

A full merge of Burrows-Wheeler transforms takes a pass over all suffixes for
every byte of the prefix length, so the corpus is cut first, without loss. A
string of ``length`` bytes has a minimizer (the least hash of its grams of
``GRAM`` bytes); equal strings have equal minimizers, and neighbouring strings
share one: they form a run. The bytes a run's strings cover are its context. A
minimizer met in one place only is in no repeated string (count-min filter,
never too low). A minimizer whose runs all have one and the same context needs
no comparison: every occurrence after the first goes whole.

What is left are minimizers with several contexts. Their contexts, each once,
are dealt by minimizer; a task cuts them to the pieces whose strings may stand
twice (equal strings have equal hashes, so none is lost), forms shards of the
pieces (of equal ones the earliest), builds the transform of each and merges these by iterative interleave
refinement (``bwt.merge``), which compares bytes.
After ``length`` rounds the places that have not parted are the repeated
intervals; the earliest place of an interval keeps its string.

Edge cases. A null text is empty. Strings never cross documents. Earlier means
a smaller id, then a smaller start; null ids come last; rows that share an id
but not the text are ordered by a hash of it, and rows equal in both are one
document given more than once, with one result. Texts shorter than ``length``
lose nothing. An empty table gives an empty result. A passage in a third of
all rows is one context, counted before the shuffle. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bwt, count_min, rolling
from tessera.llm.common import text_key
from tessera.session import materialize

LENGTH = 100
GRAM = 32
CHUNK_BYTES = 1 << 18  # texts handled as one array
GROUP_BYTES = 1 << 17  # contexts merged together, unless those of one minimizer are more
SETTLE_BYTES = 1 << 20  # contexts whose strings are hashed together, unless those of one minimizer are more
FLUSH = 1 << 17  # hashes a task holds for the sketch
SHARDS = 8


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first text, texts) of about ``CHUNK_BYTES``; no more than
    one chunk's texts are copied out of the batch."""
    at, texts, size = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_buffer().to_pybytes() if x.is_valid else b""
        if texts and size + len(t) > CHUNK_BYTES:
            yield at, texts
            at, texts, size = i, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield at, texts


def _windows(texts: list[bytes], length: int):
    laid = b"".join(texts)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    ids = np.frombuffer(laid, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return laid, starts, rolling.Windows(ids, starts, length, min(GRAM, length))


def _contexts(texts, length, may):
    """(text, start, strings, key, context) of the runs whose key passes ``may``."""
    laid, starts, win = _windows(texts, length)
    first, end = win.runs(win.valid, starts)
    chosen = may(win.key[first])
    first, end = first[chosen], end[chosen]
    doc = np.searchsorted(starts, first, side="right") - 1
    context = [laid[a:b + length - 1] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
    return doc, first - starts[doc], end - first, win.key[first].view(np.int64), context


def _class_of(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes that stand for a context."""
    import xxhash
    return tuple(np.array([xxhash.xxh3_64_intdigest(c, seed) for c in contexts], dtype=np.uint64).view(np.int64)
                 for seed in (5, 17))


def _own_repeat(context: bytes, length: int) -> bool:
    """Whether a string stands twice in the context. Then the bytes that all
    its strings have in common, or its middle if they have none, repeat too."""
    n = len(context) - length + 1
    if n < 2:
        return False
    if n <= length - 8:
        core = context[n - 1:length]
        if context.find(core) == n - 1 and context.find(core, n) < 0:
            return False
    return len({context[i:i + length] for i in range(n)}) < n


def _pieces(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, end) of the maximal runs of strings whose hash stands
    elsewhere in the contexts too; a string outside them stands once."""
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    starts = np.cumsum(size) - size
    ids = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(contexts)), size - length + 1)
    ordinal = np.arange(len(row)) - np.repeat(np.cumsum(size - length + 1) - (size - length + 1), size - length + 1)
    value = rolling.window_hash(ids, length, rolling.WINDOW_BASE)[starts[row] + ordinal]
    order = np.argsort(value)
    same = np.concatenate(([False], np.diff(value[order]) == 0, [False]))
    twice = np.zeros(len(row), dtype=bool)
    twice[order] = same[1:] | same[:-1]
    at = np.flatnonzero(twice)
    if not len(at):
        return at, at, at
    begin = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(row[at]) != 0)))
    first = at[begin]
    last = at[np.concatenate((np.flatnonzero(begin)[1:], [len(at)])) - 1]
    return row[first], ordinal[first], ordinal[last] + 1


def first_strings(keys: np.ndarray, contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For every context a mask of its strings: set if no equal string stands
    earlier among the contexts of its key, which are in order of place. Only
    the pieces of contexts whose strings may stand twice are merged, and of
    equal pieces the earliest: every string of the others stands there."""
    out = [np.ones(len(c) - length + 1, dtype=bool) for c in contexts]
    row, first, end = _pieces(contexts, length)
    spans, pieces, merged = [], [], {}
    for key, i, a, b in zip(keys[row].tolist(), row.tolist(), first.tolist(), end.tolist(), strict=True):
        piece = contexts[i][a:b + length - 1]
        if merged.setdefault((key, piece), (i, a)) == (i, a):
            spans.append((key, i, a, b))
            pieces.append(piece)
        else:
            out[i][a:b] = False
    masks = _first_in_pieces(np.array([s[0] for s in spans], dtype=keys.dtype), pieces, length)
    for (_, i, a, b), mask in zip(spans, masks, strict=True):
        out[i][a:b] = mask
    return out


def _first_in_pieces(keys: np.ndarray, contexts: list[bytes], length: int) -> list[np.ndarray]:
    """``first_strings`` by merged transforms, some keys at a time."""
    if not contexts:
        return []
    out = [np.empty(0, dtype=bool)] * len(contexts)
    cut = np.concatenate(([0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]))
    group, held = [], 0
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        group.append((a, b))
        held += sum(len(c) for c in contexts[a:b])
        if held >= GROUP_BYTES:
            _merged(group, contexts, length, out)
            group, held = [], 0
    if group:
        _merged(group, contexts, length, out)
    return out


def _merged(group: list[tuple[int, int]], contexts: list[bytes], length: int, out: list[np.ndarray]) -> None:
    """Deal the group's contexts to shards, merge their transforms, and mark
    the earliest string of each repeated interval."""
    members: list[list[int]] = [[] for _ in range(SHARDS)]
    for a, b in group:
        for i in range(a, b):
            members[i % SHARDS].append(i)
    members = [m for m in members if m]
    parts = [bwt.transform([contexts[i] for i in m]) for m in members]
    suffix, parted = bwt.merge(parts, length)
    row = np.concatenate([np.array(m)[t.string] for m, t in zip(members, parts, strict=True)])[suffix]
    offset = np.concatenate([t.offset for t in parts])[suffix]
    size = np.array([len(c) for c in contexts[group[0][0]:group[-1][1]]])
    interval = np.cumsum(parted > 0)
    string = size[row - group[0][0]] - offset >= length
    row, offset, interval = row[string], offset[string], interval[string]
    order = np.lexsort((offset, row, interval))
    earliest = np.ones(len(order), dtype=bool)
    earliest[1:] = np.diff(interval[order]) != 0
    row, offset = row[order], offset[order]
    order = np.lexsort((offset, row))
    mask, row = earliest[order], row[order]
    for i, part in zip(row[np.concatenate(([0], np.nonzero(np.diff(row))[0] + 1))].tolist(),
                       np.split(mask, np.nonzero(np.diff(row))[0] + 1), strict=True):
        out[i] = part


def class_marks(classes: DataFrame, length: int) -> DataFrame:
    """(c1, c2, fresh): for the contexts (m, c1, c2, context, first) with a
    string that stands earlier, a bit per string, set if it does not."""
    def settle(keys, c1s, c2s, all_contexts):
        """Marks of the contexts of whole keys, about ``SETTLE_BYTES`` at a time."""
        new_key = np.concatenate(([True], np.diff(keys) != 0))
        taken = np.cumsum([len(c) for c in all_contexts])
        at = 0
        while at < len(keys):
            end = int(np.searchsorted(taken, (taken[at - 1] if at else 0) + SETTLE_BYTES, side="right"))
            end = max(end, at + 1)
            while end < len(keys) and not new_key[end]:
                end += 1
            part = slice(at, end)
            yield marks_of(keys[part], c1s[part], c2s[part], all_contexts[part])
            at = end

    def marks_of(key, c1, c2, contexts):
        masks = first_strings(key, contexts, length)
        some = np.array([i for i, m in enumerate(masks) if not m.all()], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(c1[some]), pa.array(c2[some]),
             pa.array([np.packbits(masks[i]).tobytes() for i in some], pa.binary())], names=["c1", "c2", "fresh"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] + [b.column(3).to_pylist()]
            if held is not None:
                part = [np.concatenate((held[i], part[i])) for i in range(3)] + [held[3] + part[3]]
            last = int(np.searchsorted(part[0], part[0][-1]))
            if last:
                yield from settle(*(x[:last] for x in part))
            held = [x[last:] for x in part]
        if held is not None:
            yield from settle(*held)

    dealt = classes.repartition(F.col("m")).sortWithinPartitions("m", "first")
    return dealt.select("m", "c1", "c2", "context").mapInArrow(run, "c1 long, c2 long, fresh binary")


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` holds the bytes left."""
    if length < 1:
        raise ValueError("length must be positive")
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), text_key(text)[0].alias("k"))
    kind = src.schema["doc_id"].dataType.simpleString()
    n_bytes = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = count_min.width_bits(int(n_bytes * 2 / (length - min(GRAM, length) + 2)))

    def sketch_parts(batches):
        return count_min.parts((_windows(t, length)[2].selected() for b in batches for _, t in _chunks(b.column(0))),
                               bits, FLUSH)

    met = spark.sparkContext.broadcast(count_min.merge(
        src.select("text").mapInArrow(sketch_parts, count_min.PARTS), bits))

    def runs(batches, several=None):
        """Runs that may repeat; with their contexts if only those of
        minimizers with several contexts are asked for."""
        def may(key):
            out = count_min.may_repeat(key, met.value, bits)
            if several is not None:
                out[out] = count_min.may_repeat(key[out], several.value, bits)
            return out

        for b in batches:
            for at, texts in _chunks(b.column(0)):
                doc, start, n, key, context = _contexts(texts, length, may)
                c1, c2 = _class_of(context)
                rows = pa.array(doc + at)
                cols = {"m": pa.array(key), "c1": pa.array(c1), "c2": pa.array(c2), "doc_id": b.column(1).take(rows),
                        "k": b.column(2).take(rows), "at": pa.array(start)}
                if several is None:
                    cols["n"] = pa.array(n)
                    cols["own"] = pa.array([_own_repeat(c, length) for c in context], pa.bool_())
                else:
                    cols["context"] = pa.array(context, pa.binary())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    cols = src.select("text", "doc_id", "k")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k", "at")
    at_kind = f"m long, c1 long, c2 long, doc_id {kind}, k long, at long"
    found = cols.mapInArrow(runs, at_kind + ", n long, own boolean")
    classes = materialize(found.groupBy("m", "c1", "c2", "n", "own").agg(
        F.min(place).alias("first"), F.count("*").alias("times")), "suffix-classes")

    def class_parts(batches):
        # A context that repeats a string within itself counts as several.
        return count_min.parts((np.repeat(b.column(0).to_numpy().view(np.uint64),
                                          1 + b.column(1).to_numpy(zero_copy_only=False)) for b in batches), bits,
                               FLUSH)

    several = spark.sparkContext.broadcast(count_min.merge(
        classes.select("m", "own").mapInArrow(class_parts, count_min.PARTS), bits))
    contexts = (cols.mapInArrow(lambda batches: runs(batches, several), at_kind + ", context binary")
                .groupBy("m", "c1", "c2", "context").agg(F.min(place).alias("first")))
    marks = materialize(class_marks(contexts, length), "suffix-marks")
    known = (classes.join(marks, ["c1", "c2"], "left").where("times > 1 or fresh is not null")
             .select("c1", "c2", "n", "fresh", "first"))
    again = found.select("c1", "c2", "doc_id", "k", "at").join(known, ["c1", "c2"])
    first = place.eqNullSafe(F.col("first"))
    spans = (again.select("doc_id", "k", "at", "n", F.when(first, F.col("fresh")).alias("fresh"), first.alias("is_first"))
             .where("not is_first or fresh is not null").select("doc_id", "k", F.struct("at", "n", "fresh").alias("run"))
             .groupBy("doc_id", "k").agg(F.collect_set("run").alias("runs")))
    joined = (src.alias("s").join(spans.alias("p"), F.expr("s.doc_id <=> p.doc_id and s.k = p.k"), "left")
              .select("s.doc_id", "s.text", "p.runs"))

    def remove(batches):
        for b in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for x, of in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                t = np.frombuffer(x.as_buffer().to_pybytes() if x.is_valid else b"", dtype=np.uint8)
                gone = (rolling.cover(np.concatenate([_gone(r) for r in of]), length, len(t)) if of
                        else np.zeros(len(t), dtype=bool))
                out["n_bytes"].append(len(t))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum()))
                out["kept"].append(t[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v, pa.binary() if c == "kept" else pa.int64()) for c, v in out.items())],
                names=["doc_id", *out])

    return joined.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def _gone(run: dict) -> np.ndarray:
    """Starts of a run's strings that stand earlier: all, or those not fresh."""
    if run["fresh"] is None:
        return np.arange(run["at"], run["at"] + run["n"])
    fresh = np.unpackbits(np.frombuffer(run["fresh"], dtype=np.uint8))[:run["n"]]
    return run["at"] + np.nonzero(fresh == 0)[0]
