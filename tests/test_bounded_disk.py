"""What a job shuffles and writes on the way goes when it is no longer read."""
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import catalog, graph
from tessera.operators.embed import HashingEmbedder, term_counts
from tessera.session import discard, distilled, materialize, sliced
from tessera.sources import published_index
from tessera.sources.published_index import PublishedIndex


def shuffle_files(spark):
    return sum(f.startswith("shuffle_") for d in Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
               .blockManager().diskBlockManager().localDirs()[0].getPath()).iterdir() for f in os.listdir(d))


def local(df):
    return Path(df._written[0].removeprefix("file:"))


def test_shuffle_files_of_a_written_table_go(spark):
    spark.sparkContext._jvm.System.gc()
    before = spark.conf.get(session.DROP_SHUFFLES, None)
    df = spark.range(1000).repartition(7, "id").groupBy(F.col("id") % 10).count()
    there = shuffle_files(spark)
    out = materialize(df, "bounded")
    assert shuffle_files(spark) <= there and spark.conf.get(session.DROP_SHUFFLES, None) == before
    assert out.agg(F.sum("count")).first()[0] == 1000


def test_only_the_result_of_a_chain_of_written_tables_stays(spark):
    made = []

    def make():
        made.append(materialize(spark.range(5), "way"))
        made.append(distilled("inner", lambda: made[0].select((F.col("id") * 2).alias("id"))))
        return made[1].where("id > 2")
    out = distilled("end", make)
    assert sorted(r.id for r in out.collect()) == [4, 6, 8]
    assert local(out).exists() and not any(local(x).exists() for x in made)
    with pytest.raises(ZeroDivisionError):
        distilled("end", lambda: 1 // 0)
    kept = materialize(spark.range(3), "kept")
    discard(out)
    assert not local(out).exists() and kept.count() == 3


def test_texts_of_requests_some_at_a_time(spark, monkeypatch):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(40)]
    known = spark.createDataFrame([(n, f"def {n}") for n in names], "name string, declaration string")
    edges = spark.createDataFrame([(a, i, b) for j, a in enumerate(names) for i, b in enumerate(
        [*rng.sample(names[j + 1:], min(3, 39 - j)), "gone"])], "src string, pos int, dst string")
    asked = spark.createDataFrame([(r, i, n) for r in [*range(12), None] for i, n in enumerate(rng.sample(names, 3))],
                                  "req_id int, pos int, name string")
    pairs = spark.createDataFrame([("n3", "n1"), ("n5", "gone")], "name string, counterpart string")
    whole = sorted(map(str, catalog.emitted_text(asked, known, pairs, edges).collect()))
    base = Path(session.ensure_checkpoint_dir(spark).removeprefix("file:"))
    monkeypatch.setattr(catalog, "REQUESTS_AT_ONCE", 20)
    before = set(os.listdir(base))
    got = catalog.emitted_text(asked, known, pairs, edges)
    folder = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before)
    assert sorted(map(str, got.collect())) == whole and len(whole) == 13
    # nothing of a slice's rounds is left, only its text
    assert folder.count("emitted") == 2 and not {"emission", "emission-known"} & set(folder)


def test_a_round_shuffles_its_paths_once(spark, monkeypatch):
    """By request and name, the known paths beside them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, plain = [], graph.materialize

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, name)
    monkeypatch.setattr(graph, "materialize", seen)
    try:
        graph.emission_order(spark.createDataFrame([(1, 0, "a")], "req_id int, pos int, name string"),
                             spark.createDataFrame([("a", 0, "b")], "src string, pos int, dst string"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first_round = [p for n, p in plans if n == "emission"][1]
    assert first_round.count("Exchange hashpartitioning") == 3  # paths by name, edges by source, all by request and name


def test_some_rows_at_a_time_give_the_same_rows(spark):
    docs = spark.createDataFrame([(i % 23 if i % 7 else None, f"w{i % 5} w{i % 3} x") for i in range(60)],
                                 "doc_id long, text string")
    plain = term_counts(docs, "doc_id", "text")
    terms = sliced(docs, "doc_id", 25, lambda d: term_counts(d, "doc_id", "text"), "terms")
    assert len(terms._written) == 3 and sorted(map(str, terms.collect())) == sorted(map(str, plain.collect()))
    model = HashingEmbedder(16).fit_terms(terms, "doc_id")
    whole = model.transform_terms(terms, "doc_id")
    vectors = sliced(terms, "doc_id", 50, lambda t: model.transform_terms(t, "doc_id"), "vectors")
    rounded = lambda df: sorted((r.doc_id or -1, [round(x, 9) for x in r.vector]) for r in df.collect())
    assert len(vectors._written) > 1 and rounded(vectors) == rounded(whole)
    discard(terms)   # the model keeps what it needs of them
    assert model.transform(docs.limit(1), "doc_id", "text").count() == 1


def test_an_upsert_writes_some_buckets_at_a_time(spark, tmp_path, monkeypatch):
    def rows(ids, text):
        return spark.createDataFrame([(str(i), f"{text}{i}", [1.0], ("en",)) for i in ids],
                                     "id string, text string, vector array<double>, metadata struct<lang: string>")
    monkeypatch.setattr(published_index, "ROWS_AT_ONCE", 30)
    writes, plain = [], published_index.upsert_index
    monkeypatch.setattr(published_index, "upsert_index", lambda old, new: (writes.append(new.count()), plain(old, new))[1])
    ix = PublishedIndex(spark, str(tmp_path / "ix"), n_buckets=8)
    ix.upsert(rows(range(100), "a"))
    assert len(writes) > 2 and sum(writes) == 100 and max(writes) <= 30
    writes.clear()
    second = ix.upsert(rows([*range(50), 200, 200], "b"))
    # a group holds the rows that lie in its buckets already, too
    assert len(writes) > 2 and sum(writes) == 52 and second["number"] == 2
    assert {r.id: r.text for r in ix.read().collect()} == {
        str(i): f"{'b' if i < 50 or i == 200 else 'a'}{i}" for i in [*range(100), 200]}
