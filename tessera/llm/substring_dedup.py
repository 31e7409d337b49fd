"""Substring dedup: words in windows whose word sequence also starts elsewhere go.

Pass 1 builds a count-min sketch per partition and merges them. A window is
counted under its minimizer (the least hash of its grams of ``GRAM`` words),
once per place where that gram stands: the count of a minimizer is at least
the count of any window that has it, so the sketch never underestimates, and
it holds a fourteenth of the entries. Pass 2 takes only the windows estimated
at two or more and groups them exactly, by minimizer and window hash (128 bits
in all). Windows that share a minimizer travel as one row, a run; equal runs
are counted before the shuffle, so a passage that a third of the rows share is
one row per task. The marks of repeated windows go back to the texts by run.

Edge cases. A null text counts as empty. Texts of fewer than ``window`` words
lose nothing. Repeated rows are each other's copies: all their windows repeat.
An empty table gives an empty result. A text's memory is proportional to its
own length. Only the named columns are read; others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import count_min, rolling
from tessera.llm.common import text_key
from tessera.session import materialize

WINDOW = 35
GRAM = 8
CHUNK_BYTES = 2 << 20  # texts handled as one array


class _WordHash(dict):
    """Hash of each word met, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _chunks(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of pieces of a batch of bounded size."""
    texts = _texts(batch.column(text_at))
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_BYTES):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _word_windows(texts: list[bytes], known: _WordHash, window: int):
    words = [t.split() for t in texts]  # splits at ASCII white space only
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    ids = np.fromiter((known[w] for ws in words for w in ws), dtype=np.uint64, count=int(starts[-1]))
    return ids, starts, rolling.Windows(ids, starts, window, min(GRAM, window))


def _runs(ids, starts, win, sketch, bits, window):
    """Runs of windows that may repeat: (first, end, key, payload)."""
    first, end = win.runs(win.valid, starts)
    chosen = count_min.may_repeat(win.key[first], sketch, bits)
    first, end = first[chosen], end[chosen]
    if not len(first):
        return first, end, np.empty(0, dtype=np.int64), []
    h = rolling.window_hash(ids, window, rolling.WINDOW_BASE)
    return first, end, win.key[first].view(np.int64), [h[a:b].tobytes() for a, b in zip(first, end, strict=True)]


def _class_of(payloads: list[bytes]) -> pa.Array:
    import xxhash
    return pa.array(np.array([xxhash.xxh64_intdigest(p, 11) for p in payloads], dtype=np.uint64).view(np.int64))


def repeated_runs(classes: DataFrame) -> DataFrame:
    """(m, c, marks) of the run classes (m, c, payload, n) that hold repeated
    windows; marks = a bit per window, null if all are."""
    def settle(key, payload, cls, n):
        size = np.array([len(p) >> 3 for p in payload])
        row = np.repeat(np.arange(len(payload)), size)
        h = np.frombuffer(b"".join(payload), dtype=np.uint64)
        m = key[row]
        order = np.lexsort((h, m))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (m[order][1:] != m[order][:-1])))
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=n[row][order])
        mark = np.empty(len(h), dtype=bool)
        mark[order] = total[group] >= 2
        ends = np.cumsum(size)
        marked = np.add.reduceat(mark, ends - size, dtype=np.int64)
        some = np.nonzero(marked)[0]
        bits = [None if marked[i] == size[i] else np.packbits(mark[ends[i] - size[i]:ends[i]]).tobytes() for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(cls[some]), pa.array(bits, pa.binary())],
                                         names=["m", "c", "marks"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(),
                    b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)]
            if held is not None:
                part = [np.concatenate((held[0], part[0])), held[1] + part[1],
                        np.concatenate((held[2], part[2])), np.concatenate((held[3], part[3]))]
            last = int(np.searchsorted(part[0], part[0][-1]))  # the last key may go on
            if last:
                yield from settle(part[0][:last], part[1][:last], part[2][:last], part[3][:last])
            held = [x[last:] for x in part]
        if held is not None:
            yield from settle(*held)

    dealt = classes.select("m", "payload", "c", "n").repartition(F.col("m")).sortWithinPartitions("m")
    return dealt.mapInArrow(run, "m long, c long, marks binary")


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` is the kept words, joined
    by one space. Windows are judged on the input."""
    if window < 1:
        raise ValueError("window must be positive")
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), *text_key(text))
    n_bytes = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About 2 / (window - gram + 2) of the words are minimizers; words have some six bytes.
    bits = count_min.width_bits(int(n_bytes / 6 * 2 / (window - min(GRAM, window) + 2)))

    def sketch_parts(batches):
        known = _WordHash()
        return count_min.parts((_word_windows(t, known, window)[2].selected() for b in batches
                                for _, t in _chunks(b, 0)), bits)

    sketch = spark.sparkContext.broadcast(count_min.merge(
        src.select("text").mapInArrow(sketch_parts, count_min.PARTS), bits))

    def classes(batches):
        known = _WordHash()
        for b in batches:
            for _, texts in _chunks(b, 0):
                ids, starts, win = _word_windows(texts, known, window)
                _, _, key, payload = _runs(ids, starts, win, sketch.value, bits, window)
                yield pa.RecordBatch.from_arrays([pa.array(key), _class_of(payload), pa.array(payload, pa.binary())],
                                                 names=["m", "c", "payload"])

    def places(batches):
        known = _WordHash()
        for b in batches:
            for at, texts in _chunks(b, 0):
                ids, starts, win = _word_windows(texts, known, window)
                first, end, key, payload = _runs(ids, starts, win, sketch.value, bits, window)
                doc = np.searchsorted(starts, first, side="right") - 1
                rows = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), _class_of(payload), b.column(1).take(rows), b.column(2).take(rows),
                     pa.array(first - starts[doc]), pa.array(end - first)],
                    names=["m", "c", "k1", "k2", "at", "n"])

    found = (src.select("text").mapInArrow(classes, "m long, c long, payload binary")
             .groupBy("m", "c", "payload").agg(F.count("*").cast("double").alias("n")))
    marks = materialize(repeated_runs(found), "substring-marks")
    where = (src.select("text", "k1", "k2").mapInArrow(places, "m long, c long, k1 long, k2 long, at long, n long")
             .distinct())
    spans = (where.join(marks, ["m", "c"]).groupBy("k1", "k2")
             .agg(F.collect_set(F.struct("at", "n", "marks")).alias("spans")))

    def remove(batches):
        for b in batches:
            texts, spans_of = _texts(b.column(1)), b.column(2).to_pylist()
            n_words, n_removed, kept = [], [], []
            for t, runs in zip(texts, spans_of, strict=True):
                w = t.split()
                if runs:
                    gone = rolling.cover(np.concatenate([_starts(r) for r in runs]), window, len(w))
                    left = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                else:
                    left = w
                n_words.append(len(w))
                n_removed.append(len(w) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = src.schema["doc_id"].dataType.simpleString()
    joined = src.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept string")


def _starts(run: dict) -> np.ndarray:
    if run["marks"] is None:
        return np.arange(run["at"], run["at"] + run["n"])
    marks = np.unpackbits(np.frombuffer(run["marks"], dtype=np.uint8))[:run["n"]]
    return run["at"] + np.nonzero(marks)[0]
