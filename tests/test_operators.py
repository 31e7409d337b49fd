"""Operator properties, sources/sinks and plug-in points."""
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.features import WindowAgg, asof_join, range_window_features
from tessera.operators.graph import reachable, topo_levels
from tessera.operators import knn
from tessera.operators.knn import similarity_topk
from tessera.operators.mmr import mmr_order, mmr_rerank
from tessera.operators.retrieve import format_code_hits, retriever, search
from tessera.operators.embed import HashingEmbedder, PandasEmbedder
from tessera.sources import files, index_store
from tessera.session import materialize


def _vecs(spark, n=60, d=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d)], int(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vector array<double>, label int")


def _brute_topk(rows, qrows, k, exclude_self=False):
    out = {}
    for qi, qv, *_ in qrows:
        q = np.asarray(qv) / np.linalg.norm(qv)
        sc = []
        for di, dv, *_ in rows:
            if exclude_self and di == qi:
                continue
            sc.append((-round(float(q @ (np.asarray(dv) / np.linalg.norm(dv))), 12), di))
        out[qi] = [d for _, d in sorted(sc)[:k]]
    return out


def test_topk_matches_brute_force_and_blocks(spark):
    c = _vecs(spark)
    rows = [tuple(r) for r in c.collect()]
    want = _brute_topk(rows, rows, 5, exclude_self=True)
    for block in (1 << 30, 1280):  # one block, and several query blocks
        got = similarity_topk(c.withColumnRenamed("id", "qid"), c, 5, query_id="qid", doc_id="id",
                              exclude_self=True, block_bytes=block).collect()
        res = {}
        for r in sorted(got, key=lambda r: (r.qid, r["rank"])):
            res.setdefault(r.qid, []).append(r.id)
        assert res == want


def test_topk_with_repeated_queries_and_null_keys(spark):
    c = _vecs(spark)
    q = c.where("id = 1").withColumnRenamed("id", "qid")
    many = q.crossJoin(spark.range(300)).drop("id")  # one query given 300 times
    once = similarity_topk(q, c, 5, query_id="qid", doc_id="id").collect()
    assert sorted(similarity_topk(many, c, 5, query_id="qid", doc_id="id", block_bytes=1280).collect()) == sorted(once)
    keyed = c.withColumn("key", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    got = similarity_topk(keyed.withColumnRenamed("id", "qid"), keyed, 3, query_id="qid", doc_id="id",
                          match_cols=("key",), block_bytes=1280).collect()
    assert got and all(r.qid % 3 == r.id % 3 != 0 for r in got)
    assert similarity_topk(q.where("false"), c, 5, query_id="qid", doc_id="id").count() == 0


def test_topk_reads_no_query_rows_on_the_driver(spark, monkeypatch):
    frame, read = type(spark.range(1)), []
    collect = frame.collect

    def spied(self):
        rows = collect(self)
        read.append(len(rows))
        return rows
    monkeypatch.setattr(frame, "collect", spied)
    monkeypatch.delattr(frame, "toPandas")
    c = _vecs(spark)
    assert similarity_topk(c.withColumnRenamed("id", "qid"), c, 5, query_id="qid", doc_id="id").count() > 0
    # The row count with the width; for each cell of up to CELL_ROWS rows its centre, radius and queries.
    assert sum(read) <= 1 + 3 * -(-c.count() // knn.CELL_ROWS) < c.count()


def test_plan_has_no_cartesian(spark):
    c = _vecs(spark)
    df = similarity_topk(c.withColumnRenamed("id", "qid"), c, 5, query_id="qid", doc_id="id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_mmr_lambda_one_is_topk(spark):
    c = _vecs(spark)
    q = c.withColumnRenamed("id", "qid")
    a = mmr_rerank(q, c, 5, 20, 1.0, query_id="qid", doc_id="id").orderBy("qid", "rank").collect()
    b = similarity_topk(q, c, 5, query_id="qid", doc_id="id").orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in a] == [(r.qid, r.id) for r in b]


def test_mmr_prefers_diverse():
    ids = np.array([1, 2, 3])
    vecs = np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])
    rel = np.array([0.9, 0.89, 0.5])
    assert [int(ids[i]) for i in mmr_order(ids, rel, vecs, 2, 0.5)] == [1, 3]


def test_asof_never_future_and_ttl(spark):
    spine = spark.createDataFrame([(1, 7, "2024-01-02 00:00:00"), (2, 7, "2024-01-10 00:00:00"),
                                   (3, 8, "2024-01-02 00:00:00")], "sid long, k long, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    feats = spark.createDataFrame([(7, "2024-01-01 12:00:00", 1, 10.0), (7, "2024-01-02 00:00:00", 2, 20.0),
                                   (7, "2024-01-02 00:00:00", 3, 30.0), (7, "2024-01-03 00:00:00", 4, 40.0)],
                                  "k long, ts string, eid long, v double") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = {r.sid: r.v for r in asof_join(spine, feats, "k", "ts", ["v"], 2 * 86400, "eid", 3 * 86400).collect()}
    assert out == {1: 30.0, 2: None, 3: None}


def test_range_window_matches_brute(spark):
    rng = np.random.default_rng(3)
    base = pd.Timestamp("2024-01-01")
    rows = [(int(i), int(rng.integers(0, 3)), base + pd.Timedelta(seconds=int(rng.integers(0, 10 * 86400))),
             float(rng.integers(0, 100))) for i in range(300)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "k", "ts", "v"])) \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = range_window_features(df, "k", "ts", [WindowAgg("s", "sum", "v", 86400), WindowAgg("m", "max", "v", 3600)],
                                bucket_seconds=2 * 86400)
    got = {r.id: (r.s, r.m) for r in out.collect()}
    for i, k, t, _ in rows:
        inwin = [v for _, kk, tt, v in rows if kk == k and t - pd.Timedelta(days=1) < tt <= t]
        inh = [v for _, kk, tt, v in rows if kk == k and t - pd.Timedelta(hours=1) < tt <= t]
        assert got[i] == (sum(inwin), max(inh))


def test_closure_contains_seeds_and_is_idempotent(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    seeds = spark.createDataFrame([("g", 1), ("h", 4)], "group string, node long")
    r1 = reachable(seeds, edges)
    got = sorted((r.group, r.node) for r in r1.collect())
    assert got == [("g", 1), ("g", 2), ("g", 3), ("h", 4), ("h", 5)]
    again = sorted((r.group, r.node) for r in reachable(r1, edges).collect())
    assert again == got


def test_topo_levels_and_cycle(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    lv = {r.node: r.level for r in topo_levels(nodes, edges).collect()}
    assert lv == {"a": 2, "b": 1, "c": 0, "d": 0}
    cyc = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(RuntimeError):
        topo_levels(nodes, cyc)


def test_retriever_signature_and_formatting(spark):
    emb = HashingEmbedder(16)
    docs = spark.createDataFrame([("1", "alpha beta", "code A"), ("2", "beta gamma", "code B"),
                                  ("3", "gamma delta", "code A")], "id string, text string, code string")
    model = emb.fit(docs, "id", "text")
    idx = index_store.build_index(docs, "text", model.transform(docs, "id", "text"), ["code"], id_col="id")
    q = model.transform(spark.createDataFrame([(1, "beta")], "qid long, text string"), "qid", "text") \
        .withColumnRenamed("qid", "query_id")

    @retriever(index=idx, top_k=3, search_type="similarity")
    def blocks(query, filter, result):
        return format_code_hits(result)
    out = blocks(q).first()
    assert out.n_blocks == 2 and out.result.count("==== Python Code Example ====") == 2
    with pytest.raises(ValueError):
        retriever(lambda query, result: result, index=idx)
    hits = search(q, idx, 2, "similarity", {"code": "code B"}, text_key="page").collect()
    assert [(h.id, h.page) for h in hits] == [("2", "beta gamma")]


def test_pandas_embedder_plugin(spark):
    class Model:
        def embed(self, s):
            return s.map(lambda t: [float(len(t)), 1.0])
    out = PandasEmbedder("len", Model, 2).transform(
        spark.createDataFrame([(1, "abc")], "id long, t string"), "id", "t").first()
    assert out.vector == [3.0, 1.0]


def test_files_and_sinks(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "a").mkdir(parents=True)
    (root / "a" / "a.md").write_text("# T\nhello world")
    (root / "b.mdx").write_text("skip")
    (root / "bad.md").write_bytes(b"\xff\xfe bad")
    f, rej = files.read_markdown_tree(spark, str(root))
    assert [r.rel_path for r in f.collect()] == ["a/a.md"]
    assert rej.count() == 1
    code_root = tmp_path / "code"
    code_root.mkdir()
    (code_root / "x.py").write_text("print(1)\n" * 10)
    cf, _ = files.read_code_roots(spark, [(str(code_root), "native"), (str(tmp_path / "missing"), "spark")])
    assert [r.directory_type for r in cf.collect()] == ["native"]
    out = str(tmp_path / "chunks")
    df = spark.createDataFrame([("x", "1.0"), ("y", "1.1")], "t string, doc_version string")
    files.write_partitioned(df, out, "doc_version")
    files.write_partitioned(spark.createDataFrame([("z", "1.1")], "t string, doc_version string"), out, "doc_version")
    got = sorted((r.t, r.doc_version) for r in files.read_partitioned(spark, out, "doc_version").collect())
    assert got == [("x", "1.0"), ("z", "1.1")]
    one = files.read_partitioned(spark, out, "doc_version", "1.1")
    assert [r.t for r in one.collect()] == ["z"]
    assert "PartitionFilters: [isnotnull(doc_version" in one._jdf.queryExecution().executedPlan().toString()


def test_index_store(spark, tmp_path):
    path = str(tmp_path / "idx")
    with pytest.raises(FileNotFoundError):
        index_store.load_index(spark, path)
    assert index_store.read_manifest(spark, path) == {}
    assert index_store.index_model(spark, path) == index_store.DEFAULT_MODEL
    idx = spark.createDataFrame([("i1", "t", [1.0], ("u",))], "id string, text string, vector array<double>, "
                                "metadata struct<url:string>")
    index_store.write_index(spark, idx, path, "hash-32", "1.2")
    assert index_store.read_manifest(spark, path)["embedding_model"] == "hash-32"
    assert index_store.load_index(spark, path, "hash-32").count() == 1
    with pytest.raises(ValueError):
        index_store.load_index(spark, path, "hash-64")
    up = index_store.upsert_index(idx, spark.createDataFrame(
        [("i1", "t2", [2.0], ("v",)), ("i2", "n", [0.0], ("w",))], idx.schema))
    assert sorted((r.id, r.text) for r in up.collect()) == [("i1", "t2"), ("i2", "n")]


def test_materialize_uses_checkpoint_dir(spark):
    df = materialize(spark.range(5), "t")
    assert df.count() == 5
    strip = lambda u: u.split(":", 1)[-1].lstrip("/")
    assert strip(df.inputFiles()[0]).startswith(strip(spark.sparkContext.getCheckpointDir()))


def test_session_starts_across_buckets(spark):
    from tessera.operators.features import session_starts
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2024-01-01")
    rows = [(int(i), int(rng.integers(0, 2)), base + pd.Timedelta(minutes=int(rng.integers(0, 3 * 24 * 60))))
            for i in range(400)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "k", "ts"])) \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.id: r.is_session_start for r in session_starts(df, "k", "ts", 30 * 60, bucket_seconds=3600, tie_col="id").collect()}
    for i, k, t in rows:
        prev = [tt for _, kk, tt in rows if kk == k and (tt, _) < (t, i)]
        earlier = max(prev) if prev else None
        assert got[i] == (earlier is None or (t - earlier) > pd.Timedelta(minutes=30)), i


def test_tiled_windows_match_frames(spark):
    from tessera.operators.features import tiled_window_features
    rng = np.random.default_rng(11)
    base = pd.Timestamp("2024-01-01")
    rows = [(int(i), int(rng.integers(0, 3)), base + pd.Timedelta(seconds=int(rng.integers(0, 5 * 86400))),
             float(rng.integers(0, 100)), bool(rng.integers(0, 2))) for i in range(500)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "k", "ts", "v", "f"])) \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    aggs = [WindowAgg("s1h", "sum", "v", 3600), WindowAgg("mx1d", "max", "v", 86400),
            WindowAgg("mn3h", "min", "v", 3 * 3600), WindowAgg("c2d", "count_if", F.col("f"), 2 * 86400)]
    got = {r.id: tuple(r[a.name] for a in aggs) for r in tiled_window_features(df, "k", "ts", "id", aggs).collect()}
    want = {r.id: tuple(r[a.name] for a in aggs) for r in range_window_features(df, "k", "ts", aggs).collect()}
    assert got == want


def test_tiled_approx_distinct_close_to_exact(spark):
    from tessera.operators.features import tiled_window_features
    rng = np.random.default_rng(17)
    base = pd.Timestamp("2024-01-01")
    rows = [(int(i), int(rng.integers(0, 2)), base + pd.Timedelta(seconds=int(rng.integers(0, 3 * 86400))),
             int(rng.integers(0, 400))) for i in range(1500)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "k", "ts", "m"])) \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    approx = {r.id: r.d for r in tiled_window_features(
        df, "k", "ts", "id", [WindowAgg("d", "approx_distinct", "m", 86400)]).collect()}
    exact = {r.id: r.d for r in range_window_features(df, "k", "ts", [WindowAgg("d", "distinct", "m", 86400)]).collect()}
    for i, e in exact.items():
        assert abs(approx[i] - e) <= max(2, 0.05 * e), (i, approx[i], e)
