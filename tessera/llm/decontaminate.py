"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and their words joined by one space. A text region that
is within ``e`` edits of a benchmark item of ``m`` characters shares at least
m - q + 1 - e * q of its character q-grams with it, on at most e + 1
neighbouring diagonals. So each text's q-grams are looked up among the
items', hits are counted in diagonal bands that overlap by half, bands that
meet the bound are kept and verified by a banded alignment. Nothing is lost:
the filter only drops what the lemma excludes.

Items of more than ``PASSAGE`` characters are also cut into passages of that
length, one every ``STEP`` characters and one at the end, each with an edit
budget of its own and found in the same way: a copied part of PASSAGE + STEP
characters holds a passage whole. Items of fewer than ``q`` characters have no
q-gram; they are found if they stand in the text unchanged, as whole words.

The items are the query set. They are read in blocks of about
``BLOCK_CHARS`` characters, each sent to all tasks and run over all documents;
documents are never shuffled.

Edge cases. Null and blank texts match nothing; an item too short for its edit
budget gets the largest budget the lemma can filter. Passages found that
overlap are one region, with the edits of the worst of them; those that
overlap a find of the whole item are part of it. Equal
items are each reported. Repeated rows are each reported. Empty tables give
no matches. Memory is proportional to one text, or two megabytes of short
ones. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.rolling import GRAM_BASE, window_hash

Q = 12
ERROR_RATE = 0.05
PASSAGE, STEP = 192, 48  # items up to PASSAGE characters count as a whole only
BLOCK_CHARS = 2_000_000
CHUNK_CHARS, CHUNK_TEXTS = 1 << 20, 1 << 12


def normalise(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "replace").split()).decode("utf-8")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def edit_budget(m: int, q: int, rate: float) -> int:
    """Edits allowed in an item of m characters: the rate, as far as the
    lemma still asks for one shared q-gram."""
    return max(0, min(int(m * rate), (m - q) // q))


def passages(text: str) -> list[str]:
    """The item, and its passages if it is longer than one."""
    last = len(text) - PASSAGE
    return [text, *(text[a:a + PASSAGE] for a in sorted({*range(0, last, STEP), last}) if last > 0)]


class Items:
    """Q-gram index of one block of items."""

    def __init__(self, rows: list[tuple], q: int = Q, rate: float = ERROR_RATE):
        kept = [(i, n) for i, t in rows if (n := normalise(t))]
        self.q = q
        self.ids = [i for i, _ in kept]
        cut = [(k, n, j == 0) for k, (_, item) in enumerate(kept) if len(item) >= q
               for j, n in enumerate(passages(item))]
        self.of, self.texts, self.whole = ([c[j] for c in cut] for j in range(3))
        self.short: dict[int, dict[str, list[int]]] = {}
        for k, (_, item) in enumerate(kept):
            if len(item) < q:
                self.short.setdefault(len(item), {}).setdefault(item, []).append(k)
        self.budget = np.array([edit_budget(len(n), q, rate) for n in self.texts], dtype=np.int64)
        self.need = np.array([len(n) - q + 1 - e * q for n, e in zip(self.texts, self.budget, strict=True)],
                             dtype=np.int64)
        self.band = int(self.budget.max(initial=0)) + 1
        hashes = [window_hash(_points(n).astype(np.uint64), q, GRAM_BASE) for n in self.texts]
        size = [len(h) for h in hashes]
        h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(size)), size)[order]
        self.offset = (np.concatenate([np.arange(s) for s in size]) if size else np.empty(0, dtype=np.int64))[order]
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = max(16, int(np.ceil(np.log2(16 * max(1, len(self.grams))))))
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self.grams >> np.uint64(64 - self.bits)] = True

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, offset) of every q-gram shared with an item."""
        h = window_hash(points.astype(np.uint64), self.q, GRAM_BASE)
        at = np.nonzero(self.table[h >> np.uint64(64 - self.bits)])[0]
        g = np.searchsorted(self.grams, h[at])
        g[g == len(self.grams)] = 0
        real = self.grams[g] == h[at]
        at, g = at[real], g[real]
        n = self.count[g]
        row = np.repeat(np.arange(len(at)), n)
        k = np.repeat(self.first[g] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(row))
        return at[row], self.item[k], self.offset[k]

    def candidates(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, passage, band) that meet the lemma's bound."""
        if not self.texts:
            return []
        # A separator no text holds keeps q-grams inside their text.
        laid = _points("\0".join(texts))
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        at, item, offset = self.hits(laid)
        if not len(at):
            return []
        text = np.searchsorted(starts, at, side="right") - 1
        diagonal = at - starts[text] - offset + int(1 << 30)  # kept positive
        band = diagonal // self.band
        key = (text << 50) | (item << 32) | band
        keys, n = np.unique(np.concatenate((key, key - 1)), return_counts=True)  # bands k and k + 1 together
        item = (keys >> 32) & 0x3FFFF
        keys = keys[n >= self.need[item]]
        return [(int(k >> 50), int((k >> 32) & 0x3FFFF), int(k & 0xFFFFFFFF)) for k in keys]

    def exact(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, 0) of the items shorter than a q-gram."""
        if not self.short or not texts:
            return
        whole = "\0".join(texts)
        points = _points(whole).astype(np.uint64)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        for m, table in self.short.items():
            if len(points) < m:
                continue
            wanted = np.array([window_hash(_points(p).astype(np.uint64), m, GRAM_BASE)[0] for p in table])
            for s in np.flatnonzero(np.isin(window_hash(points, m, GRAM_BASE), wanted)).tolist():
                if (p := whole[s:s + m]) in table and not _inside_word(whole, s) and not _inside_word(whole, s + m):
                    t = int(np.searchsorted(starts, s, side="right")) - 1
                    at = s - int(starts[t])
                    yield from ((t, k, at, at + m, 0) for k in table[p])

    def verify(self, text: str, item: int, band: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best region of a band, if within budget."""
        p, e = self.texts[item], int(self.budget[item])
        low = band * self.band - int(1 << 30) - e
        lo, hi = max(0, low), min(len(text), low + 2 * self.band + 2 * e + len(p))
        region = text[lo:hi]
        if (found := region.find(p)) >= 0:
            return lo + found, lo + found + len(p), 0
        if e == 0:
            return None
        end, d = banded(p, region, low - lo, 2 * self.band + 2 * e)
        if d > e:
            return None
        back, _ = banded(p[::-1], region[:end][::-1], -2 * e, 4 * e)
        return lo + end - back, lo + end, d


def banded(pattern: str, text: str, low: int, width: int) -> tuple[int, int]:
    """(end, edits) of the cheapest alignment of the whole pattern with any
    part of ``text`` that stays on the diagonals low .. low + width."""
    p, t = _points(pattern), _points(text)
    big = len(p) + len(t) + 1
    d = np.arange(low, low + width + 1)
    step = np.arange(len(d))
    cost = np.where((d >= 0) & (d <= len(t)), 0, big)
    for i in range(1, len(p) + 1):
        j = d + i  # characters of the text used
        inside = (j >= 1) & (j <= len(t))
        same = np.where(inside, t[np.clip(j - 1, 0, max(0, len(t) - 1))] == p[i - 1], False) if len(t) else inside
        new = np.where(inside, cost + ~same, big)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        new = np.where((j >= 0) & (j <= len(t)), new, big)
        cost = np.minimum.accumulate(new - step) + step
        cost = np.where((j >= 0) & (j <= len(t)), cost, big)
    best = int(np.argmin(cost))
    return int(d[best] + len(p)), int(cost[best])


def _inside_word(text: str, at: int) -> bool:
    """Whether a word goes on over this place."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def _scan(items: Items, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits), overlapping finds of one item merged."""
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for t, i, band in items.candidates(texts):
        if hit := items.verify(texts[t], i, band):
            best.setdefault((t, i), []).append(hit)
    wholes: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    parts: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for (t, i), hits in best.items():
        out: list[tuple[int, int, int]] = []
        for s, e, d in sorted(hits):
            if out and s < out[-1][1]:
                if d < out[-1][2]:
                    out[-1] = (s, e, d)
            else:
                out.append((s, e, d))
        (wholes if items.whole[i] else parts).setdefault((t, items.of[i]), []).extend(out)
    for (t, i), hits in wholes.items():
        for s, e, d in hits:
            yield t, i, s, e, d
    for (t, i), hits in parts.items():
        known = wholes.get((t, i), [])
        out = []
        for s, e, d in sorted(h for h in hits if not any(h[0] < e and s < h[1] for s, e, _ in known)):
            if out and s < out[-1][1]:
                out[-1] = (out[-1][0], max(e, out[-1][1]), max(d, out[-1][2]))
            else:
                out.append((s, e, d))
        for s, e, d in out:
            yield t, i, s, e, d
    yield from items.exact(texts)


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    texts = [normalise(x) for x in column.to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < CHUNK_TEXTS and (end == at or size + len(texts[end]) <= CHUNK_CHARS):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items, a bounded block at a time."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")) \
        .where("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = ERROR_RATE,
            id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, word_start, word_end, edits) of every region of a
    document within the edit budget of an item; words count from 0."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    doc_kind = src.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType
    schema = f"doc_id {doc_kind}, item_id {item_type.simpleString()}, word_start int, word_end int, edits int"
    arrow_item = _arrow_type(item_type)
    sc, found = docs.sparkSession.sparkContext, None
    for rows in _blocks(benchmark, item_col, item_text_col):
        block = sc.broadcast(rows)  # plain values; each task builds its index

        def run(batches, block=block):
            items = Items(block.value, q, error_rate)
            for b in batches:
                for at, texts in _chunks(b.column(1)):
                    hits = list(_scan(items, texts))
                    words = [(texts[t].count(" ", 0, s), texts[t].count(" ", 0, e) + 1) for t, _, s, e, _ in hits]
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array([at + h[0] for h in hits], pa.int64())),
                        pa.array([items.ids[h[1]] for h in hits], arrow_item),
                        pa.array([w[0] for w in words], pa.int32()), pa.array([w[1] for w in words], pa.int32()),
                        pa.array([h[4] for h in hits], pa.int32())],
                        names=["doc_id", "item_id", "word_start", "word_end", "edits"])

        part = src.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = ERROR_RATE,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a region of any item."""
    at, sc, out = docs.columns.index(text_col), docs.sparkSession.sparkContext, docs
    for rows in _blocks(benchmark, item_col, item_text_col):
        block = sc.broadcast(rows)  # plain values; each task builds its index

        def run(batches, block=block):
            items = Items(block.value, q, error_rate)
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                for first, texts in _chunks(b.column(at)):
                    for hit in _scan(items, texts):
                        keep[first + hit[0]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
