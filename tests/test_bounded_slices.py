"""Streams take in slices of bounded size, however long the table is."""
import duckdb
import pytest
from oracle_util import compare
from pyspark.sql import functions as F

import tessera.plans  # noqa: F401  (registers the queries)
from tessera.plans.registry import ORACLE, QUERIES
from tessera.streaming import runner


def _events(spark, path, n=600):
    """Events of 7 users over two days, most of them in the last hours; two without a time."""
    at = F.when(F.col("id") % 4 == 0, F.col("id") * 300).otherwise(172_000 + F.col("id") % 97)
    (spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") > 1, F.timestamp_seconds(1_704_067_200 + at)).cast("timestamp_ntz").alias("ts"),
        F.element_at(F.array(F.lit("view"), F.lit("signup")), (F.col("id") % 2 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 90).cast("double").alias("value"), F.lit("{}").alias("props"))
     .write.parquet(f"{path}/events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    return con


def test_slices_are_bounded_and_in_order(spark, tmpdir_path):
    _events(spark, tmpdir_path)
    ev = spark.read.parquet(f"{tmpdir_path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    slices = runner.bounded_slices(ev, "ts", 2, f"{tmpdir_path}/slices", rows_per_task=25)
    kept = [sorted((r["ts"], r["event_id"]) for r in s.collect()) for s in slices]
    assert len(kept) >= 4 and max(map(len, kept)) <= 2 * 25 * 4
    assert all(a[-1][0] < b[0][0] for a, b in zip(kept, kept[1:], strict=False))
    assert sorted(i for s in kept for _, i in s) == list(range(2, 600))
    assert slices[0].columns == ev.columns


def test_no_rows_no_slices(spark, tmpdir_path):
    ev = spark.createDataFrame([], "ts timestamp, value double")
    assert runner.bounded_slices(ev, "ts", 4, f"{tmpdir_path}/none") == []


@pytest.mark.parametrize("name", ["stream_sliding", "stream_view"])
def test_streams_take_in_bounded_slices(spark, tmpdir_path, monkeypatch, name):
    con = _events(spark, tmpdir_path)
    monkeypatch.setattr(runner, "ROWS_PER_TASK", 50)
    landed, land = [], runner.FileStream.land

    def counted(self, df):
        landed.append(df.count())
        land(self, df)

    monkeypatch.setattr(runner.FileStream, "land", counted)
    ok, info = compare(QUERIES[name](spark, tmpdir_path), con, ORACLE[name])
    assert ok, info
    assert sum(landed) == 598 and max(landed) <= 300
