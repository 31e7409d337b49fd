"""Feature definitions: batch values, materialisation, online values, services."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.features import WindowAgg
from tessera.operators.views import BatchSource, FeatureService, FeatureView, pandas_transform
from tessera.plans.features import window_features
from tessera.sources.tables import table_path
from tests.conftest import SMALL


def _events(spark):
    return BatchSource("events", table_path(SMALL, "events"), "ts").read(spark)


def test_view_features_equal_query(spark):
    fv = FeatureView("user_amounts", ["user_id"], "ts",
                     aggregations=[WindowAgg("amt_sum_1h", "sum", "value", 3600)])
    got = {r.event_id: round(r.amt_sum_1h, 6) for r in fv.features(_events(spark)).collect()}
    want = {r.event_id: r.amt_sum_1h for r in window_features(spark, SMALL).collect()}
    assert got == want


def test_materialize_replaces_only_its_periods(spark, tmp_path):
    path = str(tmp_path / "offline")
    ev = _events(spark)
    fv = FeatureView("counts", ["user_id"], "ts", feature_start_time="2024-01-02 00:00:00")
    fv.materialize(ev, path)
    full = spark.read.parquet(path)
    assert full.filter(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).count() == 0
    day5 = F.col("period") == F.lit("2024-01-05").cast("date")
    other_before, day5_before = full.filter(~day5).count(), full.filter(day5).count()
    fv.materialize(ev.filter(F.col("user_id") % 2 == 0), path, "2024-01-05 00:00:00", "2024-01-06 00:00:00")
    after = spark.read.parquet(path)
    assert after.filter(~day5).count() == other_before
    assert 0 < after.filter(day5).count() < day5_before


def test_online_ttl_and_service(spark):
    ev = _events(spark)
    fv = FeatureView("user_latest", ["user_id"], "ts", ttl_seconds=2 * 86400)
    online = fv.online(ev, ["value"], "event_id")
    assert online.count() == ev.select("user_id").distinct().count()
    spine = spark.createDataFrame([(1, 0), (2, 999999)], "spine_id long, uid long")
    svc = FeatureService("svc", [(fv, ev, ["value"])], {"user_latest": {"user_id": "uid"}})
    rows = {r.spine_id: r["user_latest__value"] for r in svc.lookup(spine).collect()}
    assert rows[2] is None and set(rows) == {1, 2}


def test_pandas_mode_transform(spark):
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType()),
                           T.StructField("ts", T.TimestampNTZType())])
    fn = pandas_transform(lambda pdf: pdf[["user_id", "value", "ts"]], schema)
    fv = FeatureView("p", ["user_id"], "ts", transform=fn)
    assert fv.features(_events(spark)).columns == ["user_id", "value", "ts"]


def test_window_percentile_within_rank_error(spark):
    """percentile_approx(accuracy=100) is within 1/100 of the frame size in
    rank of the true median, and is one of the frame's values."""
    import pandas as pd
    from tessera.plans.features import window_percentile
    ev = _events(spark).select("event_id", "user_id", "ts", "value").toPandas()
    got = {r.event_id: r.p50_1h for r in window_percentile(spark, SMALL).collect()}
    for _, r in ev.iterrows():
        frame = ev[(ev.user_id == r.user_id) & (ev.ts <= r.ts) & (ev.ts > r.ts - pd.Timedelta(hours=1))]
        vals = sorted(frame.value)
        v = got[r.event_id]
        assert v in vals
        target = (len(vals) - 1) * 0.5
        lo, hi = vals.index(v), len(vals) - 1 - vals[::-1].index(v)
        slack = len(vals) / 100 + 1
        assert lo - slack <= target <= hi + slack


def test_one_view_in_batch_and_stream(spark):
    """The batch call gives the stream's rows wherever the stream has closed a window."""
    from tessera.plans.streams import stream_view, user_type_view
    view, live = user_type_view(), stream_view(spark, SMALL)
    batch = view.window_aggregates(_events(spark), 86400, "6 hours")
    batch = batch.withColumn("total", F.round("total", 6)).select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if c.startswith("window_") else F.col(c) for c in live.columns])
    closed = live.agg(F.max("window_end")).first()[0]
    want = batch.where(F.col("window_end") <= F.lit(closed))
    assert live.exceptAll(want).isEmpty() and want.exceptAll(live).isEmpty() and not live.isEmpty()
    late = view.window_aggregates(_events(spark).withColumn("ts", F.lit(None).cast("timestamp_ntz")), 86400)
    assert late.isEmpty()


def test_stream_aggregates_need_bounded_state(spark):
    import pytest
    with pytest.raises(ValueError, match="no state"):
        FeatureView("m", ["user_id"], "ts", aggregations=[WindowAgg("m", "median", "value", 3600)]) \
            .window_aggregates(_events(spark), 3600)
    with pytest.raises(ValueError, match="no aggregation"):
        FeatureView("m", ["user_id"], "ts").window_aggregates(_events(spark), 3600)
