"""Windows from a pyramid of tiles, against the rows themselves."""
import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators.features import US, WindowAgg, range_window_features, tiled_window_features

EPOCH = dt.datetime(2024, 1, 1)
WINDOWS = (60, 300, 5400, 3600, 7 * 3600, 86400, 3 * 86400)


def rows_of(seed, n, span):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = rng.choice([rng.randrange(span * US), rng.randrange(span // 60) * 60 * US, 5 * US])
        out.append((i, rng.choice("aab"), t, rng.choice([None, float(rng.randint(-9, 9)), float(rng.randint(-99, 99))])))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, k, EPOCH + dt.timedelta(microseconds=t), v) for i, k, t, v in rows],
                                 "id long, k string, ts timestamp_ntz, v double")


def aggs_of(seconds):
    return [WindowAgg(f"{fn}_{w}", fn, "v", w) for w in seconds for fn in ("sum", "count", "min", "max")]


def brute(rows, seconds):
    out = {}
    for i, k, t, _ in rows:
        vals = []
        for w in seconds:
            seen = [v for _, k2, t2, v in rows if k2 == k and t - w * US < t2 <= t and v is not None]
            vals += [sum(seen) if seen else None, len(seen), min(seen, default=None), max(seen, default=None)]
        out[i] = tuple(vals)
    return out


@pytest.mark.parametrize("span", [7200, 12 * 86400])
def test_every_window_equals_its_rows(spark, span):
    rows = rows_of(span, 260, span)
    aggs = aggs_of(WINDOWS)
    got = tiled_window_features(table(spark, rows), "k", "ts", "id", aggs)
    assert got.columns == ["id", "k", "ts", "v", *[a.name for a in aggs]]
    assert {r.id: tuple(r[a.name] for a in aggs) for r in got.collect()} == brute(rows, WINDOWS)


def test_windows_have_to_be_multiples_of_the_smallest_tile(spark):
    with pytest.raises(ValueError):
        tiled_window_features(table(spark, rows_of(1, 3, 99)), "k", "ts", "id", [WindowAgg("x", "sum", "v", 90)])


def test_quantile_sketches_stay_within_their_rank_error(spark):
    rng = random.Random(3)
    n = 6000
    rows = [(i, "a", i * 2 * US, rng.gauss(0, 1) if i % 10 else None) for i in range(n)]
    got = tiled_window_features(table(spark, rows), "k", "ts", "id", [
        WindowAgg("p90", "quantile_sketch", "v", 3600, (0.9, 200)), WindowAgg("p50", "quantile_sketch", "v", 3600)]).collect()
    worst = 0.0
    for r in got[::97]:
        seen = [v for _, _, t, v in rows if v is not None and (r.id - 1800) * 2 * US < t <= r.id * 2 * US]
        if not seen:
            assert r.p90 is None and r.p50 is None
            continue
        for q, value in ((0.9, r.p90), (0.5, r.p50)):
            worst = max(worst, abs(sum(v <= value for v in seen) / len(seen) - q) - 1 / len(seen))
    assert worst <= 0.04


def test_work_grows_with_the_rows_of_a_dense_tile(spark):
    """All rows in one minute: twice the rows take about twice as long, not four times."""
    aggs = [WindowAgg("s", "sum", "v", 3600), WindowAgg("m", "min", "v", 86400)]

    def seconds(n):
        df = spark.range(n).select(F.col("id"), F.lit("a").alias("k"), (F.col("id") % 7).cast("double").alias("v"),
                                   (F.lit(EPOCH) + F.make_dt_interval(secs=F.col("id") / F.lit(n / 50))).cast(
                                       "timestamp_ntz").alias("ts"))
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            tiled_window_features(df, "k", "ts", "id", aggs).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    seconds(1000)
    small, large = seconds(20_000), seconds(80_000)
    assert large < 8 * small  # a quadratic plan takes 16 times as long


def test_frames_of_values(spark):
    rows = rows_of(4, 40, 7200)
    got = range_window_features(table(spark, rows), "k", "ts", [WindowAgg("x", "values", "v", 600)]).collect()
    want = brute(rows, (600,))
    assert {r.id: len(r.x) for r in got} == {i: v[1] for i, v in want.items()}
