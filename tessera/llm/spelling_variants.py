"""Spelling variants: each word's near words, its commoner form and the root of its forms.

Two words are near if exactly one inserted, deleted or replaced code point
turns one into the other. Pairs are found by reduced-alphabet generation: every
code point is hashed to one of ``symbols`` symbols, the one-edit neighbourhood
of each reduced word is generated, and the neighbourhood is joined with the
reduced words of the vocabulary. Words that are near have reduced words that
are equal or neighbours, so no pair is lost; the join compares the words
themselves (``levenshtein``) before it hands a pair on.

Neighbourhoods mirror each other: r is a neighbour of s if s is one of r. So a
reduced word asks for itself, for all its deletions and for the replacements by
a greater symbol; insertions and replacements by a lesser symbol are the same
pairs seen from the other word, which asks for them. Each near pair thus comes
out once. A reduced word is a 64-bit hash that is updated in place for each
edit, so a word of L code points makes O(L) keys in O(L) time; equal hashes of
different reduced words only cost a comparison.

Words travel in the join; one longer than ``LONG`` code points travels as its
SHA-1, and is compared after a join that brings its text, so that a run of many
thousand letters does not repeat itself in each of its keys.

A word's form is the near word with the largest count (ties: the least in code
point order), if that count is at least ``ratio`` times the word's own. Counts
grow by ``ratio`` along the forms, so a chain of forms is short; its end is
found by pointer doubling.

Edge cases. Null words are ignored. Words that stand fewer than ``min_count``
times or have fewer than ``min_chars`` code points are not in the vocabulary:
not in the result, and no one's near word. The words of a document that is
given twice count twice. A null or empty text has no words; an empty table
gives an empty result. A word without near words has null form and n_near 0
and is its own root. Other columns may have any name.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import rolling
from tessera.session import materialize

SYMBOLS = 6
MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
LONG = 64
OWN, DELETION, REPLACEMENT = 0, 1, 2
KEYS = "key long, kind int, w string, n long"
CELLS = 1 << 21  # keys made at once
BASE = np.uint64(0xB5297A4D3F84D5A3)
LENGTH_MIX = np.uint64(0x9E3779B97F4A7C15)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(doc_id, run): the maximal runs of letters A-Z, a-z, U+00C0 to U+00FF
    with at least ``min_chars`` of them, A-Z in lower case."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), string.ascii_uppercase,
                       string.ascii_lowercase)
    found = F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]{%d,}" % min_chars), F.lit(0))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(found).alias("run"))


def vocabulary(words: DataFrame, word: Column, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and common enough."""
    return (words.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word")
            .agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out[i + 1] = out[i] * BASE
    return out


def _key(h: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return rolling.mix(h ^ (np.uint64(length) * LENGTH_MIX)).view(np.int64)


def _hashes(words: list[str], length: int, symbols: int, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(reduced symbols from 1, hash) of words of one length."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = (codes.reshape(len(words), length) % np.uint32(symbols)).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        return s, (s * power[length - 1::-1][:length]).sum(axis=1, dtype=np.uint64)


def neighbour_keys(words: list[str], length: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word, key, kind) of the reduced words asked for by
    ``words``, all of ``length`` code points."""
    power = _powers(length)
    s, whole = _hashes(words, length, symbols, power)
    place = power[length - 1::-1][:length]  # weight of each place
    at, key, kind = [np.arange(len(words))], [_key(whole, length)], [np.full(len(words), OWN)]
    with np.errstate(over="ignore"):
        weighed = s * place
        # What stands after place i keeps its weights; what stands before loses one power.
        after = np.cumsum(weighed[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1] - weighed
        before = np.cumsum(s * np.concatenate((place[1:], [np.uint64(0)])), axis=1, dtype=np.uint64)
        before = np.concatenate((np.zeros((len(words), 1), dtype=np.uint64), before[:, :-1]), axis=1)
        new = np.ones(s.shape, dtype=bool)  # deleting any of equal neighbours gives one word
        new[:, 1:] = s[:, 1:] != s[:, :-1]
        row, _ = np.nonzero(new)
        at.append(row)
        key.append(_key((before + after)[new], length - 1))
        kind.append(np.full(len(row), DELETION))
        for up in range(1, symbols):
            can = s + np.uint64(up) <= symbols
            row, _ = np.nonzero(can)
            at.append(row)
            key.append(_key((whole[:, None] + np.uint64(up) * place[None, :])[can], length))
            kind.append(np.full(len(row), REPLACEMENT))
    return np.concatenate(at), np.concatenate(key), np.concatenate(kind)


def _make_keys(symbols: int, all_keys: bool):
    def run(batches):
        for b in batches:
            words, w, n = b.column(0).to_pylist(), b.column(1), b.column(2)
            length = np.array([len(x) for x in words], dtype=np.int64)
            order = np.argsort(length, kind="stable")
            start = 0
            while start < len(order):
                size = int(length[order[start]])
                room = start + max(1, CELLS // max(1, size * symbols))
                end = min(int(np.searchsorted(length[order], size, side="right")), room)
                part = order[start:end]
                start = end
                if not size:
                    continue
                some = [words[i] for i in part]
                if all_keys:
                    at, key, kind = neighbour_keys(some, size, symbols)
                else:
                    key = _key(_hashes(some, size, symbols, _powers(size))[1], size)
                    at, kind = np.arange(len(some)), np.zeros(len(some))
                take = pa.array(part[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(kind.astype(np.int32)), w.take(take), n.take(take)],
                    names=["key", "kind", "w", "n"])
    return run


def _meet(words: DataFrame, name: Column, condition, symbols: int) -> DataFrame:
    """(a, n_a, b, n_b): words under ``name`` whose reduced words are equal or
    neighbours and that satisfy ``condition(a, b)``."""
    rows = words.select("word", name.alias("w"), "n")
    asked = rows.mapInArrow(_make_keys(symbols, True), KEYS).select("key", "kind", F.col("w").alias("a"),
                                                                     F.col("n").alias("n_a"))
    known = rows.mapInArrow(_make_keys(symbols, False), KEYS).select("key", F.col("w").alias("b"),
                                                                      F.col("n").alias("n_b"))
    once = (F.col("kind") != OWN) | (F.col("a") < F.col("b"))
    return (asked.join(known, (asked["key"] == known["key"]) & once & condition(F.col("a"), F.col("b")))
            .select("a", "n_a", "b", "n_b"))


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, n_a, b, n_b): the near words of a vocabulary (word, n), each pair
    once, in either order. ``words`` is read several times."""
    def near(a, b):
        return F.levenshtein(a, b, 1) == 1

    size = F.length("word")
    short = _meet(words.where(size <= LONG), F.col("word"), near, symbols)
    # A near word of a longer one may itself have LONG code points.
    long = words.where(size >= LONG)
    met = _meet(long, F.sha1("word"), lambda a, b: a != b, symbols)
    texts = long.select(F.sha1("word").alias("id"), "word")
    for c in ("a", "b"):
        met = met.join(texts.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}")), c)
    met = met.where(near(F.col("word_a"), F.col("word_b"))
                    & (F.greatest(F.length("word_a"), F.length("word_b")) > LONG))
    return short.unionByName(met.select(F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) whose chains end; the root is the
    last form. Each round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(now.join(ahead, "root", "left")
                          .select("word", F.coalesce("further", "root").alias("root"),
                                  F.col("further").isNotNull().alias("moved")), "variant-roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n)."""
    words = materialize(words, "variant-words")
    pairs = near_pairs(words, symbols)
    both = pairs.select(F.explode(F.array(
        *(F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("own"), F.col(y).alias("other"),
                   F.col(f"n_{y}").alias("m")) for x, y in (("a", "b"), ("b", "a"))))).alias("p")).select("p.*")
    commoner = F.when(F.col("m") >= ratio * F.col("own"), F.struct((-F.col("m")).alias("order"), "other"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(commoner).alias("best"))
    found = materialize(near.select("word", "n_near", F.col("best.other").alias("form"),
                                    (-F.col("best.order")).alias("form_n")), "variant-forms")
    ends = roots(found.where(F.col("form").isNotNull()))
    return (words.join(found.join(ends, "word", "left"), "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n",
                    F.coalesce("root", "word").alias("root")))
