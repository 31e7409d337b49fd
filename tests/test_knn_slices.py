"""Top-k by slices: the corpus passes by each slice, and nothing is copied for it."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_knn_cells import brute, clustered, found, table

from tessera.operators import knn


def test_rows_are_written_once_and_only_candidates_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    monkeypatch.setattr(knn, "TASK_ROWS", 32)
    n, k, sizes, plain = 400, 3, {}, knn.materialize

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(knn, "materialize", counted)
    df = table(spark, np.random.default_rng(3).standard_normal((n, 8)))   # no cell can be left out
    got = knn.similarity_topk(df.withColumnRenamed("id", "q"), df, k, query_id="q", exclude_self=True)
    assert sizes["knn-corpus"] == sizes["knn-queries"] == n and sizes["knn-candidates"] == n * k
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("match", [(), ("label",)])
def test_slices_and_parts_give_the_rows_of_all_pairs(spark, monkeypatch, match):
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    monkeypatch.setattr(knn, "TASK_ROWS", 60)
    monkeypatch.setattr(knn, "TASKS_AT_ONCE", 1)
    monkeypatch.setattr(knn, "SCORE_CELLS", 500)
    mat = clustered(240)
    mat[100:130] = mat[5]
    df = table(spark, mat)
    few = df.where("id < 120").withColumnRenamed("id", "q")
    got = knn.similarity_topk(few, df, 5, query_id="q", match_cols=match, exclude_self=True)
    want = brute(mat, 5, "cosine", True, [i % 3 for i in range(len(mat))] if match else None)
    assert found(got) == [r for r in want if r[0] < 120]


def test_ids_of_text_and_null(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), (None, [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [None, 1.0]), ("e", None)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (None, [0.0, 1.0])], "q long, vector array<float>")
    got = knn.similarity_topk(q, df, 2, query_id="q").collect()
    assert sorted((r.q or 0, r["rank"], r.id or "") for r in got) == [(0, 1, "c"), (0, 2, ""), (7, 1, ""), (7, 2, "a")]


def test_rows_that_come_before_the_queries_wait():
    def batch(cell, vec, qid, did):
        n = len(vec)
        return pa.RecordBatch.from_pydict({
            "_slice": pa.array([4] * n, pa.int32()), "_cell": pa.array([cell] * n, pa.int32()),
            "_qid": pa.array(qid, pa.int64()), "_did": pa.array(did, pa.int64()),
            "_vec": pa.array(vec, pa.list_(pa.float64())),
            "_floor": pa.array([-np.inf if cell < 0 else None] * n, pa.float64())})
    rows, asks = batch(0, [[1.0, 0.0], [0.0, 1.0]], [None] * 2, [1, 2]), batch(-1, [[3.0, 0.1]], [9], [None])
    args = ({4: 1}, 1, False, True, 0, np.array([[1.0, 0.0]]), np.array([2.0]))
    for order in ([rows, asks], [asks, rows], [asks, rows.slice(0, 1), rows.slice(1)]):
        out = pa.Table.from_batches(list(knn._make_scorer(*args)(iter(order)))).to_pylist()
        assert [(r["query_id"], r["doc_id"]) for r in out] == [(9, 1)]
    with pytest.raises(RuntimeError, match="missing"):
        list(knn._make_scorer({4: 2}, *args[1:])(iter([asks, rows])))
    with pytest.raises(ValueError, match="different lengths"):
        knn._arrow_matrix(pa.array([[1.0], [1.0, 2.0]]))


def test_repeated_query_rows_are_one(spark):
    q = table(spark, np.eye(3), "q").select("q", "vector")
    side = knn._side(q.unionByName(q.where("q = 1")).unionByName(q.where(F.col("q") == 1)), "q", "vector", (), "_qid")
    assert sorted(r._qid for r in knn._distinct(side).collect()) == [0, 1, 2]


def test_small_ranges_are_one_slice(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    monkeypatch.setattr(knn, "TASK_ROWS", 60)
    frame, tasks = type(spark.range(1)), []
    ranges, plain = frame.repartitionByRange, frame.coalesce
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols: ranges(
        self, 40 if isinstance(n, int) else n, *cols))
    monkeypatch.setattr(frame, "coalesce", lambda self, n: (tasks.append(n), plain(self, n))[1])
    mat = clustered(240)
    df = table(spark, mat)
    got = knn.similarity_topk(df.withColumnRenamed("id", "q"), df, 3, query_id="q")
    assert found(got) == brute(mat, 3, "cosine", False) and 4 <= len(tasks) <= 4 * 6
