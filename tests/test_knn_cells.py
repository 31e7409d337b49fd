"""Top-k by cells: the same rows as all pairs, with far fewer scores."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn

RNG = np.random.default_rng(6)


def clustered(n, clusters=12, width=16, spread=0.05):
    middle = RNG.standard_normal((clusters, width)) * 3
    return middle[RNG.integers(0, clusters, n)] + RNG.standard_normal((n, width)) * spread


def table(spark, mat, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(mat)],
                                 f"{name} long, vector array<double>, label int")


def brute(mat, k, metric, exclude_self, label=None):
    m = knn._unit(mat) if metric == "cosine" else mat
    s = np.round(m @ m.T, knn.SCORE_DECIMALS)
    out = []
    for i in range(len(mat)):
        keep = [j for j in range(len(mat)) if np.isfinite(s[i, j]) and not (exclude_self and i == j)
                and (label is None or label[i] == label[j])]
        keep.sort(key=lambda j: (-s[i, j], j))
        out += [(i, r + 1, j, round(float(s[i, j]), 9)) for r, j in enumerate(keep[:k])]
    return out


def found(df):
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_same_rows_as_all_pairs(spark, monkeypatch, metric, exclude_self):
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    mat = clustered(500)
    mat[::3] = mat[0]     # a third of the corpus is one vector
    mat[7] = 0.0
    mat[11] = np.nan
    df = table(spark, mat)
    got = knn.similarity_topk(df.withColumnRenamed("id", "q"), df, 6, query_id="q", exclude_self=exclude_self,
                              metric=metric, block_bytes=40 * (8 * 16 + 64))
    assert found(got) == brute(mat, 6, metric, exclude_self)


def test_matching_columns(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    mat = clustered(300)
    df = table(spark, mat)
    got = knn.similarity_topk(df.withColumnRenamed("id", "q"), df, 4, query_id="q", match_cols=("label",))
    assert found(got) == brute(mat, 4, "cosine", False, [i % 3 for i in range(len(mat))])


def scored(left, right, keys):
    a, b = (x.groupBy(*keys).count().withColumnRenamed("count", n) for x, n in ((left, "x"), (right, "y")))
    return a.join(b, keys).agg(F.sum(F.col("x") * F.col("y"))).first()[0]


def test_clusters_are_not_scored_against_each_other(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 50)
    mat = clustered(4000)
    df = table(spark, mat)
    plan = knn.block_plan(df.withColumnRenamed("id", "q"), df, 10, query_id="q", exclude_self=True)
    assert scored(*plan) < 0.25 * len(mat) ** 2
    monkeypatch.setattr(knn, "CELL_ROWS", 1 << 20)  # one cell: all pairs
    plan = knn.block_plan(df.withColumnRenamed("id", "q"), df, 10, query_id="q", exclude_self=True)
    assert scored(*plan) == len(mat) ** 2


def test_parts_of_a_repeated_vector_are_bounded(spark):
    df = table(spark, np.ones((900, 4)))
    same = df.select(F.lit(1).alias("id"), "vector")
    left, right, keys = knn.block_plan(df.limit(3).withColumnRenamed("id", "q"), same, 5, query_id="q",
                                       block_bytes=50 * (8 * 4 + 64))
    assert right.groupBy(*keys).count().agg(F.max("count")).first()[0] < 150
    got = knn.similarity_topk(df.limit(3).withColumnRenamed("id", "q"), same, 5, query_id="q",
                              block_bytes=50 * (8 * 4 + 64)).collect()
    assert len(got) == 15 and {r.id for r in got} == {1}


def test_copies_count_once_for_each_place(spark):
    mat = clustered(200)
    mat[40:160] = mat[3]
    df = table(spark, mat)
    left, right, _ = knn.block_plan(df.withColumnRenamed("id", "q"), df, 4, query_id="q", exclude_self=True)
    # 80 rows as before, and of the copies one for each place and one for the query itself
    assert right.select("_did").distinct().count() == 79 + 5
    got = knn.similarity_topk(df.withColumnRenamed("id", "q"), df, 4, query_id="q", match_cols=("label",),
                              exclude_self=True)
    assert found(got) == brute(mat, 4, "cosine", True, [i % 3 for i in range(len(mat))])


def test_scores_with_centres_are_held_for_few_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "PLAN_CELLS", 64)
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    cells = knn._centres(knn._side(table(spark, clustered(300)), "id", "vector", (), "_did"), [], 300, 16, True)
    assert len(cells.centres) == 19 and max(1, knn.PLAN_CELLS // len(cells.centres)) == 3
    df = table(spark, clustered(300))
    plain = knn._Cells.nearest

    def nearest(self, mat):
        if len(mat) > 3:
            raise AssertionError(f"{len(mat)} rows at once")
        return plain(self, mat)
    monkeypatch.setattr(knn._Cells, "nearest", nearest)
    assert knn.similarity_topk(df.withColumnRenamed("id", "q"), df, 2, query_id="q").count() == 600


def test_cells_without_rows_of_a_key_are_not_asked(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    mat = clustered(600)
    df = table(spark, mat).withColumn("label", (F.col("id") >= 300).cast("int"))
    left, right, keys = knn.block_plan(df.withColumnRenamed("id", "q"), df, 3, query_id="q", match_cols=("label",))
    asked, there = (x.select(*keys).distinct() for x in (left, right))
    assert asked.join(there, keys, "left_anti").isEmpty()


def test_cut_without_a_full_sort():
    rng = np.random.default_rng(1)
    s = np.round(rng.standard_normal((50, 300)), 1)
    s[0], s[1, 5:], s[2, 7] = -np.inf, np.nan, np.inf
    ids = rng.permutation(300)
    best, at = knn._topk_merge(None, None, s, ids, 8)
    for i in range(2, 50):
        order = sorted(range(300), key=lambda j: (-s[i, j], ids[j]))[:8]
        assert at[i].tolist() == [ids[j] for j in order] and best[i].tolist() == s[i, order].tolist()
    assert not np.isfinite(best[0]).any() and sorted(best[1][np.isfinite(best[1])].tolist()) == sorted(s[1, :5].tolist())
