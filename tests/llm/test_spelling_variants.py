"""Spelling variants against a comparison of all pairs, and edge cases."""
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, spelling_variants

SCHEMA = "doc_id long, text string, word string, n long, form string"


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(count, ratio=10):
    out = {}
    for w, n in count.items():
        near = [x for x in count if is_near(w, x)]
        best = min(near, key=lambda x: (-count[x], x), default=None)
        form = best if best is not None and count[best] >= ratio * n else None
        out[w] = (n, len(near), form, count[form] if form else None)
    ends = {}
    for w in count:
        at = w
        while out[at][2]:
            at = out[at][2]
        ends[w] = at
    return sorted((w, *out[w], ends[w]) for w in count)


def made_words(seed):
    rng = random.Random(seed)
    count = {}

    def put(w, n):
        count[w] = n

    for _ in range(60):
        w = "".join(rng.choice("abcdeéÿn") for _ in range(rng.randint(7, 11)))
        put(w, rng.choice([2, 5, 50, 500, 5000]))
        for _ in range(6):
            at = rng.randrange(len(w))
            put(rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abc") + w[at:],
                            w[:at] + rng.choice("abcé") + w[at + 1:]]), rng.choice([2, 5, 50, 50, 500]))
    # Runs of one letter, and words around the length from which texts stay behind.
    for n in (62, 63, 64, 65, 66, 300):
        w = "".join(rng.choice("abcdefgh") for _ in range(n))
        for k, x in enumerate((w, w[1:], w + "x", w[:9] + "z" + w[10:], "a" * n, "a" * (n + 1), "b" + "a" * (n - 1))):
            put(x, 2 * 10 ** (k % 4))
    return count


@pytest.mark.parametrize("symbols", [1, 6])
def test_variants_match_all_pairs(spark, symbols):
    count = made_words(symbols)
    found = spelling_variants.variants(spark.createDataFrame(list(count.items()), "word string, n long"),
                                       symbols=symbols)
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(tuple(r) for r in found.collect()) == brute(count)


def test_chain_of_forms_ends_at_the_last(spark):
    words = [("a" * 20 + "b" * i, 2 * 10 ** i) for i in range(12)]
    got = {r.word: r.root for r in spelling_variants.variants(
        spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1][0]}


def test_neighbour_keys_name_the_reduced_words(spark):
    rng = random.Random(3)

    def key(r):
        return spelling_variants._key(spelling_variants._hashes([r], len(r), 6, spelling_variants._powers(len(r)))[1],
                                      len(r))[0]

    letters = {x % 6: chr(x) for x in range(96, 102)}
    for _ in range(50):
        w = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
        r = [ord(c) % 6 for c in w]
        want = {(0, tuple(r))} | {(1, tuple(r[:i] + r[i + 1:])) for i in range(len(r))}
        want |= {(2, tuple(r[:i] + [c] + r[i + 1:])) for i in range(len(r)) for c in range(r[i] + 1, 6)}
        _, keys, kinds = spelling_variants.neighbour_keys([w], len(w), 6)
        got = sorted(zip(kinds.tolist(), keys.tolist(), strict=True))
        assert got == sorted((k, int(key("".join(letters[x] for x in t)))) for k, t in want)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], SCHEMA)


def expected_words(rows):
    count = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                w = run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]
                count[w] = count.get(w, 0) + 1
            run = ""
    return {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}


def test_words_of_documents(spark):
    rng = random.Random(9)
    vocab = ["Straßenbahn", "ÉCOLIÈRE", "notebook", "notebooks", "short", "CIÓNMENTE", "x1", "öffentlich-", "a×b÷cdefgh"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "\n \t"), (3, rows[3][1]), (3, rows[3][1]), (503, "longword" * 4000 + " ok"),
             (504, "longword" * 4000 + "s"), (505, "longword" * 4000)]
    docs = documents(spark, rows)
    words = spelling_variants.vocabulary(queries.slipped_words(docs), F.col("word"))
    want = expected_words(rows)
    assert {r.word: r.n for r in words.collect()} == want
    got = sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root)
                 for r in spelling_variants.variants(words).collect())
    assert got == brute(want)


def test_empty_and_wordless_tables(spark):
    for rows in ([], [(1, None), (None, "")]):
        words = spelling_variants.vocabulary(queries.slipped_words(documents(spark, rows)), F.col("word"))
        assert spelling_variants.variants(words).collect() == []
