"""Whitening against numpy's solvers, and edge cases."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bidiagonal, queries, whitening
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, component int, n string"
RNG = np.random.default_rng(4)


def triangle(x):
    r = np.linalg.qr(x, mode="r")
    return np.vstack((r, np.zeros((x.shape[1] - r.shape[0], x.shape[1]))))


def rotation(d):
    return np.linalg.qr(RNG.standard_normal((d, d)))[0]


SPREADS = {
    "random": RNG.standard_normal((400, 48)),
    "repeated": (rotation(48) * np.array([5.0] * 16 + [3.0] * 16 + [1.0] * 16)) @ rotation(48),
    "close": (rotation(48) * (1 + 1e-10 * np.arange(48))) @ rotation(48),
    "graded": (rotation(48) * 10.0 ** -(np.arange(48) / 8)) @ rotation(48),
    "diagonal": np.diag(np.arange(1.0, 33)),
    "identity": np.eye(16),
    "one column": RNG.standard_normal((9, 1)),
}


@pytest.mark.parametrize("name", SPREADS)
def test_solver_matches_numpy(name):
    r = triangle(SPREADS[name])
    d = r.shape[1]
    values, vectors = bidiagonal.right_singular(r, d)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.abs(np.sqrt(values) - want).max() <= 1e-13 * want[0]
    assert vectors.shape == (d, d)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-7
    top = vectors[:, :8]
    assert np.abs(top.T @ top - np.eye(top.shape[1])).max() < 1e-10
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() <= 1e-11 * values[0]


def test_small_values_keep_their_digits():
    a, b = np.array([1.0, 1e-5, 1e-10, 1e-3]), np.array([1e-6, 1e-12, 1e-9])
    got = np.sqrt(bidiagonal.qd_values(a * a, b * b))
    # The least value by the determinant, which a bidiagonal gives exactly.
    assert math.isclose(got.prod(), a.prod(), rel_tol=1e-13)
    assert math.isclose(got[-1], 1e-10, rel_tol=1e-6)


def test_zero_variance_has_no_vectors():
    assert bidiagonal.right_singular(np.zeros((4, 4)), 4)[1].shape == (4, 0)
    x = RNG.standard_normal((30, 3))
    values, vectors = bidiagonal.right_singular(triangle(np.hstack((x, x, np.zeros((30, 2))))), 8)
    assert vectors.shape == (8, 3)


def brute(rows):
    """Rows of the contract by integer arithmetic and numpy's eigensolver."""
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows]
    x = np.array([v for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = n * x - s
    centred = dev.astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:8]
    return n, [int((d * d).sum()) for d in dev], (centred @ v[:, order]) / np.sqrt(e[order]), e[order] / e.sum()


def compare(got, rows):
    n, deviation, white, explained = brute(rows)
    k = white.shape[1]
    assert len(got) == len(rows) * k
    ids = [i for i, _ in rows]
    signs = {}
    for r in got:
        at = ids.index(r.vec_id)
        assert r.n == n and r.deviation == deviation[at]
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        assert 0 <= r.identity_error < 1e-9
        want = white[at, r.component - 1]
        assert math.isclose(abs(r.whitened), abs(want), rel_tol=1e-6, abs_tol=1e-7)
        if abs(want) > 1e-3:
            signs.setdefault(r.component, set()).add(r.whitened * want > 0)
    assert all(len(v) == 1 for v in signs.values())


def test_query_matches_integers_and_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = queries.op12_embedding_whitening(spark, SMALL)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), rows)


def test_many_small_tasks_fold_to_the_same(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = [(i, [float(c) for c in RNG.standard_normal(6) * [9, 7, 5, 3, 2, 1]]) for i in range(300)]
    vectors = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(29)
    got = whitening.whiten(vectors.select("*", whitening.quantise(F.col("embedding"), 1024, 100_000).alias("x")),
                           "vec_id", "x").collect()
    compare(got, [(i, np.array(v, dtype=np.float32)) for i, v in rows])
    assert {r.component for r in got} == set(range(1, 7))


def run(spark, rows):
    vectors = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)
    return whitening.whiten(vectors.select("*", whitening.quantise(F.col("embedding"), 1024, 100_000).alias("x")),
                            "vec_id", "x").collect()


def test_unusable_vectors_are_dropped(spark):
    good = [(i, [float(c) for c in RNG.standard_normal(4)]) for i in range(40)]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [1.0, float("nan"), 2.0, 3.0]), (93, []),
           (94, [1.0, float("inf"), 2.0, 3.0]), (95, [1.0, 2.0]), (96, [float("-inf")] * 4)]
    got = run(spark, good + bad)
    assert {r.vec_id for r in got} == set(range(40))
    compare(got, [(i, np.array(v, dtype=np.float32)) for i, v in good])


def test_repeated_null_ids_and_huge_entries(spark):
    rows = [(None, [1.0, 2.0])] * 3 + [(5, [1.0, 2.0])] * 2 + [(6, [3.0, -1.0]), (7, [3.0e38, 1.0])]
    got = run(spark, rows)
    assert len(got) == len(rows) * 2
    assert {r.n for r in got} == {7}
    few = run(spark, rows[:-1])
    assert {r.component for r in few} == {1}  # two different points lie on one line
    assert all(r.identity_error < 1e-9 for r in few)


def test_no_spread_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [])]) == []
    assert run(spark, [(1, [1.0, 2.0])] * 5) == []
    assert run(spark, [(1, [1.0, 2.0])]) == []


def test_deviation_beyond_a_long_is_null():
    dev = np.array([[1 << 40, 0], [3, 4]], dtype=np.int64)
    assert whitening._square_sums(dev) == [None, 25]
    big = whitening._deviations(np.array([[1 << 45], [0]], dtype=np.int64), 1 << 30, np.array([5], dtype=object))
    assert big.tolist() == [[(1 << 75) - 5], [-5]]
