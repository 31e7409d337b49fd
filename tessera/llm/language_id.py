"""Language identification with segmentation-marginalised unigram models.

Every language has a probability for each piece of a fixed public vocabulary.
A word, with the space before it, is a byte string; its probability in a
language is the sum over all its segmentations into pieces of the product of
their probabilities, by a forward pass. A text's score is the product over its
words, and languages are compared by posterior under equal priors.

Probabilities are learnt by expectation maximisation over the word counts of
labelled documents, at most about ``sample_per_lang`` documents of each
language, drawn by a hash of the id. Prediction reads every whole text.
What is sent to tasks is the vocabulary and its probabilities: ``pieces x
languages`` numbers, whose size is checked against ``MAX_MODEL_BYTES``.

Edge cases. A null text, and one without a letter, gets ``und`` and score 0;
so does every text if nothing can be learnt from. A null lang, a null id or a
null text is not learnt from, and a null id is not held out. Ties go to the
first language in order of name. Repeated rows are predicted alike. Empty
tables give empty results. Words longer than ``UNIT`` bytes are scored as
consecutive units. Only the named columns are read; lang and id take no part
in a prediction.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import words
from tessera.llm.rolling import mix
from tessera.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
UNIT = 32                     # bytes of one scored unit; keeps products above underflow
CACHE = 1 << 19               # units a task remembers
MAX_MODEL_BYTES = 256 << 20
SMOOTHING = 0.01
UND = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file, in rank order, that fit a unit."""
    with open(path, "rb") as f:
        found = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in found if len(p) <= UNIT]


class Segmenter:
    """Finds the pieces that stand at every place of many units at once."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        h = np.array([self._hash_one(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order.astype(np.int64)
        self.bits = max(8, int(np.ceil(np.log2(16 * max(1, self.n)))))
        at = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        self.first = at.astype(np.int32)
        self.deepest = int(np.diff(at).max(initial=0))

    @staticmethod
    def _hash_one(piece: bytes) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([h], dtype=np.uint64))[0])

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each (mixed) hash, -1 if there is none."""
        cell = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        out = np.full(len(h), -1, dtype=np.int64)
        for k in range(self.deepest):
            may = np.nonzero(at + k < end)[0]
            if not len(may):
                break
            pos = at[may] + k
            ok = self.hashes[pos] == h[may]
            out[may[ok]] = self.ids[pos[ok]]
        return out

    def spans(self, units: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of units of one length (n x length),
        in order of start."""
        n, length = units.shape
        for i in range(length):
            h = np.zeros(n, dtype=np.uint64)
            for j in range(i, min(length, i + self.longest)):
                h = h * _BASE + (units[:, j].astype(np.uint64) + np.uint64(1))
                piece = self.lookup(mix(h))
                rows = np.nonzero(piece >= 0)[0]
                if len(rows):
                    yield i, j + 1, rows, piece[rows]


def _by_length(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(u) for u in units])
    for n in np.unique(size):
        at = np.nonzero(size == n)[0]
        for k in range(0, len(at), 1 << 14):
            part = at[k:k + (1 << 14)]
            yield part, np.frombuffer(b"".join(units[i] for i in part), dtype=np.uint8).reshape(len(part), int(n))


def log_scores(units: list[bytes], seg: Segmenter, p: np.ndarray) -> np.ndarray:
    """log P(unit | language), summed over all segmentations: (units, languages)."""
    out = np.zeros((len(units), p.shape[1]))
    for at, block in _by_length(units):
        alpha = np.zeros((block.shape[1] + 1, len(at), p.shape[1]))
        alpha[0] = 1.0
        for i, j, rows, piece in seg.spans(block):
            alpha[j, rows] += alpha[i, rows] * p[piece]
        out[at] = np.log(np.maximum(alpha[-1], 1e-300))
    return out


def expected_counts(units: list[bytes], weight: np.ndarray, seg: Segmenter, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece per language, by forward and backward
    passes; weight: (units, languages) counts."""
    out = np.zeros((seg.n, p.shape[1]))
    for at, block in _by_length(units):
        spans = list(seg.spans(block))
        length = block.shape[1]
        alpha = np.zeros((length + 1, len(at), p.shape[1]))
        beta = np.zeros_like(alpha)
        alpha[0], beta[length] = 1.0, 1.0
        for i, j, rows, piece in spans:
            alpha[j, rows] += alpha[i, rows] * p[piece]
        for i, j, rows, piece in reversed(spans):
            beta[i, rows] += beta[j, rows] * p[piece]
        if not spans:
            continue
        scale = weight[at] / np.maximum(alpha[length], 1e-300)
        use = np.concatenate([alpha[i, rows] * p[piece] * beta[j, rows] * scale[rows] for i, j, rows, piece in spans])
        met, row = np.unique(np.concatenate([piece for *_, piece in spans]), return_inverse=True)
        for lang in range(p.shape[1]):
            out[met, lang] += np.bincount(row, weights=use[:, lang], minlength=len(met))
    return out


def units_of(word: bytes) -> list[bytes]:
    w = b" " + word
    return [w[i:i + UNIT] for i in range(0, len(w), UNIT)]


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    p: np.ndarray  # pieces x languages


def fit(docs: DataFrame, learn: Column, vocabulary: str = VOCABULARY, sample_per_lang: int = 2_000, rounds: int = 3,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows where ``learn`` holds and id, text and lang are not null."""
    spark = docs.sparkSession
    pieces = load_pieces(vocabulary)
    key, text, lang = (F.col(f"`{c}`") for c in (id_col, text_col, lang_col))
    rows = docs.where(learn & key.isNotNull() & text.isNotNull() & lang.isNotNull()).select(
        F.xxhash64(key, F.lit(1)).alias("h"), lang.cast("string").alias("lang"), text.cast("string").alias("text"))
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(count)
    if 8 * len(pieces) * len(languages) > MAX_MODEL_BYTES:
        raise ValueError(f"a model of {len(languages)} languages is too large")
    if not languages:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    share = F.lit(1.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample_per_lang / count[name]))).otherwise(share)
    number = {name: i for i, name in enumerate(languages)}
    drawn = rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)
    counts = materialize(
        drawn.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word")
        .agg(F.count("*").alias("n")).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n")))
                                                          .alias("n")), "language-words")
    p = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, p))

        def expect(batches, sent=sent):
            seg, total = Segmenter(sent.value[0]), np.zeros((len(pieces), len(languages)))
            for b in batches:
                units, weight = [], []
                for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    of = [0] * len(languages)
                    for name, k in n:
                        of[number[name]] = k
                    for u in units_of(word.encode()):
                        units.append(u)
                        weight.append(of)
                if units:
                    total += expected_counts(units, np.array(weight, dtype=float), seg, sent.value[1])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()),
                                              pa.array(total[piece, lang])], names=["piece", "lang", "n"])

        summed = counts.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(
            F.sum("n").alias("n")).toPandas()  # at most pieces x languages rows
        found = np.full((len(pieces), len(languages)), SMOOTHING)
        found[summed["piece"], summed["lang"]] += summed["n"]
        p = found / found.sum(axis=0)
    return Model(languages, pieces, p)


class _Scorer:
    def __init__(self, seg: Segmenter, p: np.ndarray):
        self.seg, self.p = seg, p
        self.known: dict[bytes, int] = {}
        self.table = np.empty((CACHE, p.shape[1]))

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        """Log scores of texts: the sums over their units."""
        units = []
        ends = []
        for t in texts:
            for w in t.split():
                if len(w) < UNIT:
                    units.append(w)
                else:
                    units.extend(b"\n" + u for u in units_of(w))  # no word holds a line break
            ends.append(len(units))
        new = set(units).difference(self.known)
        if len(self.known) + len(new) > len(self.table):
            self.known.clear()
            new = set(units)
            if len(new) > len(self.table):
                self.table = np.empty((len(new), self.p.shape[1]))
        if new:
            new = sorted(new)
            first = len(self.known)
            self.table[first:first + len(new)] = log_scores(
                [u[1:] if u[:1] == b"\n" else b" " + u for u in new], self.seg, self.p)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        at = np.fromiter(map(self.known.__getitem__, units), dtype=np.int64, count=len(units))
        total = np.zeros((len(at) + 1, self.p.shape[1]))
        np.cumsum(self.table[at], axis=0, out=total[1:])
        ends = np.array(ends)
        return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.p))

    def run(batches):
        languages, pieces, p = sent.value
        scorer = _Scorer(Segmenter(pieces), p) if languages else None
        for b in batches:
            texts = b.column(1).to_pylist()
            lettered = [i for i, t in enumerate(texts) if scorer and t and any(map(str.isalpha, t))]
            lang, score = [UND] * len(texts), [0.0] * len(texts)
            at = 0
            while at < len(lettered):
                part, size = [], 0
                while at < len(lettered) and size < 1 << 20:
                    part.append(lettered[at])
                    size += len(texts[lettered[at]])
                    at += 1
                ll = scorer.of_texts([texts[i].encode("utf-8", "replace") for i in part])
                best = ll.argmax(axis=1)
                post = 1.0 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
                for i, k, s in zip(part, best.tolist(), post.tolist(), strict=True):
                    lang[i], score[i] = languages[k], s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
