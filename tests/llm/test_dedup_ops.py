"""Substring, suffix, line and SimHash dedup against brute force, and edge cases."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bwt, line_dedup, simhash, substring_dedup, suffix_dedup
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


def small_texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def made_texts():
    """Copies, shared passages, periods, nulls, blanks, short and long texts."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    shared = prose(60)
    base = prose(120)
    texts = [base, base, base + " end", shared, prose(30) + "\n" + shared + "\n" + prose(40), shared + " " + shared,
             "ab " * 200, "x" * 450, None, "", "   \n\t ", "one", prose(4000), prose(50) + " " + base[:300], "x" * 90]
    texts += [prose(rng.randint(1, 200)) for _ in range(20)]
    return list(enumerate(texts))


def brute_substring(texts, window):
    count, words = collections.Counter(), []
    for i, t in texts:
        w = (t or "").encode().split()
        words.append((i, w))
        count.update(tuple(w[k:k + window]) for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [35, 5])
def test_substring_matches_brute_force(spark, window):
    texts = made_texts()
    got = [tuple(r) for r in substring_dedup.dedup(documents(spark, texts), window).collect()]
    assert sorted(got, key=repr) == brute_substring(texts, window)


def test_substring_on_the_small_table(spark):
    texts = small_texts(spark)
    got = [tuple(r) for r in substring_dedup.dedup(documents(spark, texts)).collect()]
    assert sorted(got, key=repr) == brute_substring(texts, 35)


def brute_suffix(texts, length):
    seen, out = set(), []
    for i, t in sorted(texts):
        t = (t or "").encode()
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if t[k:k + length] in seen:
                gone[k:k + length] = True
            seen.add(t[k:k + length])
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length", [100, 12])
def test_suffix_matches_brute_force(spark, length):
    texts = made_texts()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                 for r in suffix_dedup.dedup(documents(spark, texts), length).collect())
    assert got == brute_suffix(texts, length)


def test_suffix_on_the_small_table(spark):
    texts = small_texts(spark)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                 for r in suffix_dedup.dedup(documents(spark, texts)).collect())
    assert got == brute_suffix(texts, 100)


@pytest.mark.parametrize("length", [1, 2, 5, 8])
def test_first_strings_match_brute_force(length):
    rng = random.Random(length)
    for _ in range(100):
        contexts = [bytes(rng.choice(b"abc") for _ in range(length + rng.randint(0, 20))) for _ in range(rng.randint(1, 25))]
        masks = suffix_dedup.first_strings(np.zeros(len(contexts), dtype=np.int64), contexts, length)
        seen = set()
        for context, mask in zip(contexts, masks, strict=True):
            for i in range(len(context) - length + 1):
                assert mask[i] == (context[i:i + length] not in seen)
                seen.add(context[i:i + length])


def test_bwt_merge_sorts_and_finds_repeats():
    rng = random.Random(2)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 8))]
        shards = [s for s in (strings[i::3] for i in range(3)) if s]
        parts = [bwt.transform(s) for s in shards]
        depth = rng.randint(1, 10)
        order, parted = bwt.merge(parts, depth)
        suffixes = [s[k][o:] for s, t in zip(shards, parts, strict=True) for k, o in zip(t.string, t.offset, strict=True)]
        merged = [suffixes[i] for i in order]
        assert sorted(order.tolist()) == list(range(len(order)))
        for i in range(1, len(merged)):
            a, b = merged[i - 1][:depth], merged[i][:depth]
            assert a <= b
            assert (parted[i] == 0) == (a == b and len(a) == depth)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(texts, threshold=line_dedup.THRESHOLD):
    first, out = {}, []
    for i, t in sorted(texts, key=lambda x: x[0]):
        for no, line in enumerate((t or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                first.setdefault(line, (i, no))
    near = set()
    lines = [x for x in first if len(x) >= line_dedup.MIN_CHARS]
    for a in lines:
        for b in lines:
            if first[b] < first[a] and abs(len(a) - len(b)) <= threshold and edit_distance(a, b) <= threshold:
                near.add(a)
    for i, t in texts:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        ls = t.split("\n")
        kept = [x for no, x in enumerate(ls) if not re.search(r"[^\x20\x09-\x0D]", x)
                or (first[x] == (i, no) and x not in near)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_texts():
    rng = random.Random(9)

    def line(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n)).strip() or "z"

    pool = [line(rng.randint(20, 60)) for _ in range(25)]
    for x in list(pool):
        for _ in range(3):
            y = list(x)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(y))
                y[k:k + 1] = rng.choice([[], [rng.choice("xyz")], [y[k], rng.choice("xyz")]])
            pool.append("".join(y))
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    return list(enumerate([*texts, None, "", "\n\n", "short\nshort\nshor", pool[0]]))


def test_lines_match_brute_force(spark):
    texts = line_texts()
    rows = line_dedup.dedup(documents(spark, texts), out="d").select("doc_id", "d.n_lines", "d.n_removed", "d.text")
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == brute_lines(texts)


def test_line_stage_keeps_columns_and_drops_emptied_documents(spark):
    a = "a line that is long enough to be compared"
    docs = documents(spark, [(1, a), (2, a), (3, a + "\nown line of this text, also long"), (4, None)])
    docs = docs.selectExpr("*", "1 as a", "2 as b", "3 as line", "4 as __dedup", "5 as no")
    got = line_dedup.clean(docs).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [1, 3, 4]
    assert got[1].text == "own line of this text, also long" and got[1].n_chars == len(got[1].text)
    assert got[0].asDict().keys() == dict.fromkeys(docs.columns).keys() and got[0]["__dedup"] == 4


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    """Other texts under one id, or none, are documents of their own."""
    texts = [(1, "own one\nin five rows"), (None, "a\nb\nc\nd\nin five rows\ne"), (None, "b"), (None, "f\nb"),
             (None, "g\nin five rows"), (5, "h\nk"), (5, "m\nk\nin five rows"), (5, "h"), (None, "in five rows"),
             (None, None)]
    rows = line_dedup.dedup(documents(spark, texts), out="d").select("doc_id", "text", "d.n_removed", "d.text").collect()
    kept = collections.Counter(x for r in rows if r[3] for x in r[3].split("\n") if x)
    assert kept == {x: 1 for _, t in texts if t for x in t.split("\n")}
    for _, text, n, left in rows:
        assert text is None and left is None or n == len(text.split("\n")) - len([x for x in left.split("\n") if x])
    assert "in five rows" in next(r for r in rows if r.doc_id == 1)[3]
    assert line_dedup.clean(documents(spark, texts)).count() == len({r[1] for r in rows if r[1] is None or r[3]})


def test_numbered_lines_make_rows_in_proportion(spark):
    """Lines that differ in a number share segments, and few of them are near."""
    rng = random.Random(8)
    sizes = {}
    for n in (60, 300, 1200):
        texts = [(i, f"The record number {rng.randrange(10 ** 9):09d} was filed in the archive today.") for i in range(n)]
        found = line_dedup.occurrences(documents(spark, texts), "doc_id", "text")
        sizes[n] = line_dedup.shared_segments(found, line_dedup.THRESHOLD).count()
        assert sizes[n] <= 12 * n
    texts = [(i, f"The record number {rng.randrange(2000):04d} was filed in the archive today.") for i in range(60)]
    got = line_dedup.dedup(documents(spark, texts), out="d").select("doc_id", "d.n_lines", "d.n_removed", "d.text")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(texts)
    assert sizes[1200] <= 5 * sizes[300] + 100


def test_lines_that_share_a_name_are_compared(spark):
    """Two different lines with equal hash bits and counts, which only the flag keeps apart."""
    tail = " is the number of this record in the archive"
    n = F.col("id")
    x = F.concat(n.cast("string"), F.lit(" ab"), F.lit(tail))
    y = F.concat(n.cast("string"), F.lit(" ba"), F.lit(tail))
    pair = (spark.range(1 << 24).where(F.shiftrightunsigned(F.xxhash64(x), line_dedup.HASH_SHIFT)
                                       == F.shiftrightunsigned(F.xxhash64(y), line_dedup.HASH_SHIFT))
            .select(x.alias("x"), y.alias("y"), (line_dedup._name(x) == line_dedup._name(y)).alias("same")).first())
    assert pair.same
    rows = line_dedup.dedup(documents(spark, [(1, pair.x), (2, pair.y), (3, pair.x[:-9] + "register")]), out="d")
    assert sorted((r.doc_id, r.d.n_removed) for r in rows.collect()) == [(1, 0), (2, 1), (3, 0)]


def brute_simhash(texts, shingle=3, distance=3):
    fps = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[k:k + shingle]) for k in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))))
    up = {i: i for i, _ in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= distance:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, f"{f:016x}", root(i)) for i, f in fps)


def test_simhash_matches_brute_force(spark):
    texts = [*made_texts(), (100, ""), (101, "Two Words"), (102, "two words")]
    got = simhash.near_duplicates(documents(spark, texts)).select(
        "doc_id", simhash.hex_fingerprint("fp"), "component_id")
    assert sorted(tuple(r) for r in got.collect()) == brute_simhash(texts)


@pytest.mark.parametrize("near", [0, 1])
def test_simhash_links_at_every_distance(spark, near):
    """Dense clusters and exact distances: the links' components equal those of all pairs."""
    rng = random.Random(near)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
            x = rng.choice([x, y])
    fps = sorted(fps)
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(df, 3, near).collect()]
    got = {f: f for f in fps}

    def root2(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in edges:
        a, b = (int(np.int64(v).view(np.uint64)) for v in (a, b))
        x, y = root2(a), root2(b)
        got[max(x, y)] = min(x, y)
    assert {f: root(f) for f in fps} == {f: root2(f) for f in fps}


def test_simhash_stage_keeps_one_of_each_group(spark):
    docs = documents(spark, [(5, "a b c d e f"), (3, "A B c d e f"), (9, None), (7, ""), (None, "a b c d e f")])
    docs = docs.withColumn("component_id", docs.doc_id).withColumn("fp", docs.doc_id)
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["3", "7", "None"]


@pytest.mark.parametrize("op", [
    substring_dedup.dedup, suffix_dedup.dedup, simhash.near_duplicates, simhash.keep_one, line_dedup.dedup,
    line_dedup.clean])
def test_empty_tables(spark, op):
    assert op(documents(spark, [(1, "x")]).where("false")).count() == 0


@pytest.mark.parametrize("op", [
    substring_dedup.dedup, suffix_dedup.dedup, simhash.near_duplicates, line_dedup.dedup])
def test_repeated_rows_and_nulls_keep_a_row_each(spark, op):
    long = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [(1, long), (1, long), (None, long), (None, None), (2, None)])
    docs = docs.selectExpr("*", "1 as k1", "2 as k", "3 as m", "4 as runs", "5 as first")
    rows = op(docs).collect()
    assert collections.Counter(r.doc_id for r in rows) == {1: 2, None: 2, 2: 1}
    assert len({tuple(map(str, r)) for r in rows if r.doc_id == 1}) == 1


def test_digest_of_kept_words(spark):
    import __spark_entry__ as E
    rows = E.queries()["op2_substring_dedup"](spark, SMALL).collect()
    want = {i: hashlib.sha256(kept.encode()).hexdigest() for i, _, _, kept in brute_substring(small_texts(spark), 35)}
    assert {r.doc_id: r.kept_sha256 for r in rows} == want


def test_suffix_settles_whole_keys_in_small_lots(spark, monkeypatch):
    rows = [(i, f"{i % 5} " + "the same passage stands in many texts " * 2 + str(i % 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(suffix_dedup.dedup(docs, 20).drop("kept").collect())
    monkeypatch.setattr(suffix_dedup, "SETTLE_BYTES", 1)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 64)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 16)
    assert sorted(suffix_dedup.dedup(docs, 20).drop("kept").collect()) == want
    assert sum(r["n_removed"] for r in want) > 0


def test_keep_one_tells_texts_of_one_id_apart(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (2, "nobody else has this text at all"),
                             (4, "p q r s t u"), (4, "p q r s t u"), (4, "P q r s t u"), (5, None), (6, "")])
    docs = docs.selectExpr("*", "1 as last", "2 as id", "3 as k1", "4 as __gone")
    rows = collections.Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    four = [(t, n) for (i, t), n in rows.items() if i == 4]
    assert four in ([("p q r s t u", 2)], [("P q r s t u", 1)])  # one text of the id stays, with its repeated row
    assert {k: n for k, n in rows.items() if k[0] != 4} == {
        (1, "a b c d e f"): 1, (2, "nobody else has this text at all"): 1, (5, None): 1}


def test_suffix_equal_pieces_are_merged_once(monkeypatch):
    op = suffix_dedup
    said = b"the same passage stands in every one of these contexts, between words of their own"
    other = b"0123456789" * 3 + b"another one is found whole, and then only up to its first part"
    contexts = [bytes([65 + i]) * 9 + said + bytes([75 + i]) * 9 for i in range(5)] + [other, other[:60] + b"!" * 30]
    keys = np.array([1] * 5 + [2] * 2)
    merged, merge = [], op._first_in_pieces

    def counted(keys, pieces, length):
        merged.extend(pieces)
        return merge(keys, pieces, length)

    monkeypatch.setattr(op, "_first_in_pieces", counted)
    masks = op.first_strings(keys, contexts, 40)
    for i, (key, mask) in enumerate(zip(keys, masks, strict=True)):
        seen = {c[j:j + 40] for c in (x for k, x in zip(keys[:i], contexts[:i], strict=True) if k == key)
                for j in range(len(c) - 39)}
        assert mask.tolist() == [contexts[i].find(contexts[i][j:j + 40]) == j and contexts[i][j:j + 40] not in seen
                                 for j in range(len(contexts[i]) - 39)]
    assert merged.count(said) == 1 and len(merged) == 2
