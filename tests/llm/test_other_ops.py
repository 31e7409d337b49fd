"""Quality rules, packing, sharding, decontamination, language id, licences and
the pipeline: brute force, oracles and edge cases."""
import collections
import random
import re

import pytest

import __spark_entry__ as E
import corpus_pipeline
from tessera.llm import decontaminate, language_id, license_scan, packing, quality_rules, sharding
from tests.conftest import MEDIUM, SMALL
from tests.llm.test_dedup_ops import brute_lines, brute_simhash, documents, edit_distance
from tests.oracle_util import compare, duck


@pytest.mark.parametrize("name", ["op9_quality_rules", "op4_sharding"])
def test_oracles_on_the_larger_table(spark, name):
    ok, info = compare(E.queries()[name](spark, MEDIUM), duck(MEDIUM), E.oracle_sql()[name])
    assert ok, info


def test_quality_edge_cases(spark):
    words = " ".join(f"the w{i} of" for i in range(40))
    texts = [(1, words), (2, None), (3, ""), (4, "a b c a b c a b c"), (5, "### " * 80), (None, words), (1, words)]
    docs = documents(spark, texts).selectExpr("*", "1 as kept", "2 as q")
    assert collections.Counter(r.doc_id for r in quality_rules.keep(docs).collect()) == {1: 2, None: 1}
    assert quality_rules.keep(docs).columns == docs.columns
    from pyspark.sql import functions as F
    got = {r.doc_id: r.q for r in docs.drop("q").select("doc_id", quality_rules.verdicts(F.col("text")).alias("q"))
           .collect()}
    assert got[4].n_repeat_words == 9 and got[2].n_words == 0 and got[2].base_failed and not got[5].kept
    assert quality_rules.keep(docs.where("false")).count() == 0


def brute_padding(histogram, k):
    """Least padded size over all choices of at most k bucket lengths."""
    import itertools
    lengths = sorted(histogram)
    best = None
    for n in range(1, k + 1):
        for inner in itertools.combinations(lengths[:-1], n - 1):
            bounds = [*inner, lengths[-1]]
            size = sum(next(b for b in bounds if x <= b) * c for x, c in histogram.items())
            best = size if best is None else min(best, size)
    return best


def test_bucket_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        h = {rng.randint(1, 60): rng.randint(1, 50) for _ in range(rng.randint(1, 9))}
        k = rng.randint(1, 4)
        bounds = packing.optimal_boundaries(h, k)
        assert len(bounds) <= k and bounds[-1] == max(h)
        size = sum(next(b for b in bounds if x <= b) * c for x, c in h.items())
        assert size == brute_padding(h, k)
    assert packing.optimal_boundaries({}, 3) == []


@pytest.mark.parametrize("slice_pieces", [20_000, 7])
def test_packing_covers_every_token_once(spark, monkeypatch, slice_pieces):
    monkeypatch.setattr(packing, "SLICE_PIECES", slice_pieces)
    rng = random.Random(8)
    texts = [(i, " ".join(["w"] * rng.randint(0, 90))) for i in range(120)] + [(None, "a b"), (7, "a b c"), (500, None)]
    config = packing.PackingConfig(max_len=32, n_buckets=4, batch_tokens=100)
    rows = packing.pack(documents(spark, texts).selectExpr("*", "1 as n_tokens", "2 as slice", "3 as h"), config).collect()
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    want = collections.Counter()
    for i, t in texts:
        want[i] += len((t or "").split())
    assert got == +want
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_len and r.start == r.piece * 32
        batches[r.bucket_len, r.batch_id].append(r.slot)
    short = collections.Counter()
    for (bucket, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= 100 // bucket
        short[bucket] += len(slots) < 100 // bucket
    assert all(n <= 1 for n in short.values())
    assert packing.pack(documents(spark, texts).where("false"), config).count() == 0


def test_equal_rows_without_id_are_dealt_to_many_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_PIECES", 20)
    docs = documents(spark, [(None, "a b c")] * 400 + [(1, "a b c d")] * 200 + [(i, "x") for i in range(10)])
    cut = packing.materialize(packing.pieces(docs, packing.PackingConfig()).selectExpr(
        "*", "monotonically_increasing_id() as row"), "test-pieces")
    dealt = packing._dealt_by(cut, 20).selectExpr("pmod(deal, 30) as slice").groupBy("slice").count().collect()
    assert len(dealt) > 25 and max(r["count"] for r in dealt) < 60
    rows = packing.pack(docs.selectExpr("*", "1 as row", "2 as piece", "3 as bucket_len", "4 as batch_id"),
                        packing.PackingConfig(max_len=8, batch_tokens=64), texts=True).collect()
    assert collections.Counter(r.text for r in rows) == {"a b c": 400, "a b c d": 200, "x": 10}
    slots = collections.Counter((r.bucket_len, r.batch_id, r.slot) for r in rows)
    assert max(slots.values()) == 1


def test_texts_of_shared_ids_and_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = documents(spark, [(1, "a b"), (1, "c d"), (None, "e"), (None, "f"), (2, long), (3, None), (4, " ")])
    rows = packing.pack(docs, texts=True).collect()
    assert sorted(r.text for r in rows if r.doc_id != 2) == ["a b", "c d", "e", "f"]
    pieces = sorted((r for r in rows if r.doc_id == 2), key=lambda r: r.piece)
    assert " ".join(r.text for r in pieces) == long and [r.start for r in pieces] == [0, 4096, 8192, 12288, 16384]


def test_written_shards_keep_every_row_once(spark, tmp_path):
    texts = [(5, "x" * 900)] * 3 + [(None, "y" * 700), (5, "other"), (6, None), (7, "z" * 5000)]
    docs = documents(spark, texts).selectExpr("*", "'mine' as shard", "1 as __row")
    path = str(tmp_path / "shards")
    name = sharding.write_shards(docs, path, 1_000)
    back = spark.read.parquet(path)
    assert name == "_shard" and set(back.columns) == {*docs.columns, "_shard"}
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter(texts)
    sizes = collections.Counter()
    for r in back.collect():
        sizes[r["_shard"]] += len(r.text or "")
    assert all(n <= 1_000 or n == 5000 for n in sizes.values()) and all(s.startswith("b") for s in sizes)


def test_shards_fit_and_split_only_when_needed(spark):
    rng = random.Random(3)
    texts = [(i, "x" * rng.randint(1, 400)) for i in range(300)] + [(7, "same" * 20)] * 60 + [(1000, "y" * 5000), (None, None)]
    rows = sharding.assign(documents(spark, texts).selectExpr("*", "1 as hash", "2 as prefix", "3 as d"), 2_000).collect()
    assert len(rows) == len(texts)
    size = collections.Counter()
    for r in rows:
        assert len(r.shard) == r.depth
        size[r.shard] += r.n_bytes
    for shard, n in size.items():
        assert n <= 2_000 or [r.oversized for r in rows if r.shard == shard] == [True]
        if shard:  # the bucket it came from was too large
            assert sum(r.n_bytes for r in rows if r.shard.startswith(shard[:-1])) > 2_000
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    assert sharding.assign(documents(spark, texts).where("false"), 10).count() == 0


def test_sharding_deep_levels_match_the_statement(spark):
    from tessera.llm import oracles
    limit = 4_000
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ok, info = compare(sharding.assign(docs, limit), duck(SMALL), oracles.SHARDING.format(limit=limit))
    assert ok, info


def _mutate(rng, text, n):
    y = list(text)
    for _ in range(n):
        if not y:
            break
        k = rng.randrange(len(y))
        y[k:k + 1] = rng.choice([[], [rng.choice("xyz")], [y[k], rng.choice("xyz")]])
    return "".join(y)


def _infix(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_matches_full_alignment(spark):
    rng = random.Random(6)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))

    items = [(k, prose(rng.randint(12, 30))) for k in range(8)] + [(8, None), (9, "tiny"), (10, ""), (0, prose(20))]
    texts = []
    for d in range(60):
        p = rng.choice(items[:8])[1]
        texts.append((d, prose(rng.randint(0, 12)) + " " + _mutate(rng, p, rng.randint(0, 9)).upper() + "\n " + prose(9)))
    texts += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts).selectExpr("*", "1 as item_id", "2 as edits")
    got = decontaminate.matches(docs, bench).collect()
    best = collections.defaultdict(lambda: 99)
    for r in got:
        best[r.doc_id, r.item_id] = min(best[r.doc_id, r.item_id], r.edits)
    want = {}
    for d, t in texts:
        n = decontaminate.normalise(t)
        for k, p in items:
            p = decontaminate.normalise(p)
            if len(p) >= decontaminate.Q:
                e = decontaminate.edit_budget(len(p), decontaminate.Q, decontaminate.ERROR_RATE)
                if (x := _infix(p, n)) <= e:
                    want[d, k] = min(x, want.get((d, k), 99))
    assert dict(best) == want and any(want.values())
    left = decontaminate.decontaminate(docs, bench)
    hit = {d for d, _ in want}
    assert left.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(d) for d, _ in texts if d not in hit)
    for r in got:
        words = decontaminate.normalise(dict(texts)[r.doc_id]).split(" ")[r.word_start:r.word_end]
        assert _infix(decontaminate.normalise(dict(items[:8])[r.item_id]) if r.item_id else "", " ".join(words)) <= 99
    assert decontaminate.matches(docs.where("false"), bench).count() == 0
    assert decontaminate.matches(docs, bench.where("false")).count() == 0


def test_parts_of_long_items_and_short_items_are_found(spark):
    rng = random.Random(16)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))

    item = prose(160)
    assert len(item) > 700
    bench = spark.createDataFrame([(1, item), (2, "Q7 zz"), (3, "c++")], "item_id long, text string")
    half = item[len(item) // 2:]
    texts = [(0, prose(20) + " " + item[:len(item) * 9 // 10] + " " + prose(20)), (1, prose(9) + " " + half),
             (2, prose(5) + " " + _mutate(rng, half, 6) + " " + prose(5)), (3, prose(50) + " " + item[300:360]),
             (4, "in (q7  ZZ), so"), (5, "aq7 zz and q7 zzb"), (6, "use C++."), (7, "cc++"), (8, item), (9, None)]
    got = collections.defaultdict(list)
    for r in decontaminate.matches(documents(spark, texts), bench).collect():
        got[r.doc_id].append((r.item_id, r.word_start, r.word_end, r.edits))
    assert {d: {x[0] for x in v} for d, v in got.items()} == {0: {1}, 1: {1}, 2: {1}, 4: {2}, 6: {3}, 8: {1}}
    assert got[4] == [(2, 1, 3, 0)] and got[8] == [(1, 0, 160, 0)]
    [(_, first, last, edits)] = got[0]
    found = " ".join(texts[0][1].split()[first:last])
    assert edits <= 9 and len(found) >= len(item) * 9 // 10 - 2 * decontaminate.STEP
    left = decontaminate.decontaminate(documents(spark, texts), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 7, 9]


def test_banded_alignment_equals_edit_distance():
    rng = random.Random(7)
    for _ in range(60):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        t = _mutate(rng, p, rng.randint(0, 4))
        _, d = decontaminate.banded(p, t, -len(p) - 1, 2 * len(p) + len(t) + 2)
        assert d == _infix(p, t) <= edit_distance(p, t)


def test_segmentations_are_summed():
    import numpy as np
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"abab"]
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces), 2))
    p /= p.sum(axis=0)
    seg = language_id.Segmenter(pieces)

    def brute(u, k):
        if not u:
            return 1.0
        return sum(p[i, k] * brute(u[len(x):], k) for i, x in enumerate(pieces) if u.startswith(x))

    units = [b" abab", b" ba", b" a", b" bbaab"]
    got = language_id.log_scores(units, seg, p)
    assert np.allclose(np.exp(got), [[brute(u, k) for k in range(2)] for u in units])
    # Expected counts: pieces' bytes add up to the units' bytes.
    n = language_id.expected_counts(units, np.ones((4, 2)), seg, p)
    assert np.allclose((n * np.array([[len(x)] for x in pieces])).sum(axis=0), sum(map(len, units)))


def test_language_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    rows = E.queries()["op7_language_id"](spark, MEDIUM).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and 0.25 < len(held) / len(rows) < 0.42
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame(
        [(i, "the house is old and the " + "x" * (i % 3), "en") for i in range(30)]
        + [(100 + i, "das haus ist alt und der " + "y" * (i % 3), "de") for i in range(30)]
        + [(200, None, "en"), (201, "123 ...", "de"), (202, "", None), (None, "the house", "en"),
           (203, "das haus " + "z" * 500, None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, ~language_id.held_out(docs.doc_id))
    got = {r.doc_id: r for r in language_id.predict(docs.withColumn("score", docs.lang), model).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[201].score == 0
    assert got[None].lang_pred == "en" and got[203].lang_pred == "de" and got[105].lang_pred == "de"
    empty = docs.where("false")
    nothing = language_id.fit(empty, ~language_id.held_out(empty.doc_id))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_licences_and_inheritance(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/x/1.txt", "plain words of prose"),
            ("a/x/2.txt", "first\nLicensed under the Apache License, Version 2.0.\nlast"),
            ("a/b/COPYING.md", "Licensed under CC BY-NC 4.0."), ("a/b/c/3.txt", None), ("b/4.txt", "license of nothing"),
            ("LICENSE", "some text without any"), (None, "All rights reserved."), ("a/x/1.txt", "plain words of prose")]
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, path string, text string")
    files = files.selectExpr("*", "'z' as license", "'z' as dir", "'z' as near")
    got = {r.n: (r.license, r.origin, r.license_dir) for r in license_scan.scan(files.select("n", "path", "text", "dir"),
                                                                               carry=("n",)).collect()}
    assert got[0] == ("MIT", "own", None) and got[1] == got[8] == ("MIT", "inherited", "a")
    assert got[2][:2] == ("Apache-2.0", "own") and got[4] == ("CC-BY-NC-4.0", "inherited", "a/b")
    assert got[5] == (None, "none", None) == got[6] and len(got) == len(rows)
    assert license_scan.scan(files.where("false")).count() == 0


def licence_scorer(texts):
    """TF-IDF cosine of a unit to its best template, df counted for every word."""
    import math

    def words(t):
        return collections.Counter(x for w in re.split(r"[^a-z0-9.-]+", t.lower()) if (x := w.strip(".-")))

    df = collections.Counter(w for t in texts for w in set(words(t or "")))

    def vector(t):
        v = {w: (1 + math.log(n)) * (1 + math.log((1 + len(texts)) / (1 + df[w]))) for w, n in words(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    templates = [vector(t) for _, t in license_scan.TEMPLATES]

    def score(unit):
        mine = vector(unit)
        return max(sum(x * mine.get(w, 0) for w, x in t.items()) for t in templates)
    return score


def brute_licence_score(texts, line):
    return licence_scorer(texts)(line)


def test_licence_lines_weigh_all_words_by_their_frequency(spark):
    lines = ["It was released under the MIT License as that.", "Released as it was under the MIT License.",
             "Released for all under the MIT License."]
    plain = ["it was as that and so on - for you, under the..."] * 300 + [None, "", "all of it", "mit license"]
    texts = plain + lines
    files = spark.createDataFrame([(f"d/{i}.txt", t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: (r.license, r.score) for r in license_scan.own_licences(files).collect()}
    for i, line in enumerate(lines, len(plain)):
        want = brute_licence_score(texts, line)
        assert want >= 0.7 and got[f"d/{i}.txt"] == ("MIT", pytest.approx(want, abs=1e-5))


def brute_units(path, text):
    parts = re.split(r"\n[^a-zA-Z0-9]*\n", text)
    out = {x for p in parts for x in [p, *p.split("\n")]}
    lines = text.split("\n")
    n = next((i for i, x in enumerate(lines) if not re.match(r"\s*(#|//|/\*|\*|--|;|%|<!--)", x)), len(lines))
    return out | ({text} if re.search(license_scan.LICENCE_FILE, path) else set()) | ({"\n".join(lines[:n])} if n else set())


def test_headers_headings_tags_and_whole_texts(spark):
    mit, mit_part, apache, gpl, bsd, mpl = (t for _, t in license_scan.TEXTS)
    wrap = lambda t, mark: "\n".join(f"{mark} {' '.join(w)}" for w in zip(*[iter(t.split())] * 6, strict=False))
    files = {
        "s/1.py": ("MIT", "# SPDX-License-Identifier: MIT\nx = 1"),
        "s/2.c": ("GPL-3.0", "// SPDX-License-Identifier: GPL-3.0-or-later"),
        "s/3.py": ("Apache-2.0", wrap(apache, "#") + "\n\nimport os"),
        "s/4.c": ("GPL-3.0", "/* file.c\n *\n" + wrap(gpl, " *") + "\n */\nint main;"),
        "s/5.js": ("MPL-2.0", wrap(mpl, "//") + "\nlet x"),
        "s/6.txt": ("MIT", "some words\n\n" + wrap(mit_part, "") + "\n\nmore words"),
        "s/7.txt": ("MIT", "MIT License\nCopyright (c) 2020 Some One"),
        "l/LICENSE": ("MIT", "Copyright 2020 Some One\n\n" + mit.replace(":\n", ":\n\n").replace("Software.\n", "Software.\n\n")),
        "g/COPYING": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nmuch more follows here"),
        "a/LICENSE.txt": ("Apache-2.0", "   Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/"),
        "b/LICENSE": ("BSD-3-Clause", "Copyright 2020\n\n" + bsd),
        "n/1.txt": (None, "the software was in the general public view and its version had a notice"),
        "n/2.txt": (None, "# a comment about the license of nothing\n#\n# and copies of it"),
        "n/3.txt": (None, "word " * 20_000),
    }
    rows = [(p, t) for p, (_, t) in files.items()] + [(f"p/{i}.txt", "the of a in to and or for this it is that with") for i in range(40)]
    found = license_scan.own_licences(spark.createDataFrame(rows, "path string, text string")).collect()
    got = {r.path: (r.license, r.score) for r in found}
    texts = [t for _, t in rows]
    score = licence_scorer(texts)
    for path, (want, text) in files.items():
        assert got.get(path, (None, 0))[0] == want, path
        best = max(score(u) for u in brute_units(path, text))
        assert got[path][1] == pytest.approx(best, abs=1e-5) if want else best < 0.7, path


def test_files_of_one_path_or_of_none(spark):
    rows = [(1, "a/x", "Released under the MIT License."), (2, "a/x", "plain"), (3, None, "All rights reserved."),
            (4, None, None), (5, "a/x", "Released under the MIT License.")]
    got = {r.n: (r.license, r.origin) for r in license_scan.scan(
        spark.createDataFrame(rows, "n int, path string, text string"), carry=("n",)).collect()}
    assert got == {1: ("MIT", "own"), 2: (None, "none"), 3: ("proprietary", "own"), 4: (None, "none"), 5: ("MIT", "own")}


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in E.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in E.queries()


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Each stage against its rule, judged on the stage's own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]

    def step(name, df):
        out = str(tmp_path / name.replace(" ", "-"))
        stages[name](spark, df, SMALL).write.parquet(out)
        return spark.read.parquet(out)

    kept = step("quality rules", docs)
    con = duck(SMALL)
    want = [r[0] for r in con.execute(f"SELECT doc_id FROM ({E.oracle_sql()['op9_quality_rules']}) WHERE kept").fetchall()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == docs.columns
    lines = step("line dedup", kept)
    want = {i: t for i, _, gone, t in brute_lines([(r.doc_id, r.text) for r in kept.collect()])
            if not gone or t.strip()}
    assert {r.doc_id: r.text for r in lines.collect()} == want and lines.columns == docs.columns
    near = step("simhash near-dedup", lines)
    want = {c for _, _, c in brute_simhash([(r.doc_id, r.text) for r in lines.collect()])}
    assert {r.doc_id for r in near.collect()} == want and near.columns == docs.columns
    clean = step("benchmark decontamination", near)
    want = {r.doc_id for r in near.collect()
            if not any(decontaminate.normalise(b) in decontaminate.normalise(r.text) for _, b in bench)}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns
    packed = step("packing", clean).collect()
    tokens = collections.Counter()
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
    assert tokens == {r.doc_id: len(r.text.encode().split()) for r in clean.collect()}
    whole = collections.defaultdict(list)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        whole[r.doc_id].append(r.text)
    assert {i: " ".join(t) for i, t in whole.items()} == {
        r.doc_id: b" ".join(r.text.encode().split()).decode() for r in clean.collect() if r.text.split()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, packed))
