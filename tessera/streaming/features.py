"""Stream features: one definition for batch and Structured Streaming.

Every transformation here takes a DataFrame that may be batch or streaming
(J4): the same function computes the backfill and the live result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.features import WindowAgg, sketch_state, sketch_value


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time must be TIMESTAMP for watermarks; inputs are TIMESTAMP_NTZ
    (read as UTC wall time)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def sliding_aggregates(df: DataFrame, key: str, ts: str, value: str, window: str = "1 hour",
                       slide: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sliding-window count and sum per key (J1). In a stream the watermark
    closes windows (append mode emits each window once, when final); in a
    batch the watermark is ignored."""
    w = F.window(F.col(ts), window, slide)
    src = df.withWatermark(ts, delay) if df.isStreaming else df
    return (src.groupBy(key, w.alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
            .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total"))


def windowed_aggregates(df: DataFrame, keys: list[str], ts: str, aggs: list[WindowAgg], window: str = "1 hour",
                        slide: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Any mergeable aggregates of a view over sliding windows per key (J1,
    J4): sums, counts, minima, maxima, distinct counts from an HLL sketch and
    quantiles from a KLL sketch (both exact for few values), so that the state
    of a window has a bounded size. Windows close as in ``sliding_aggregates``; rows without an event
    time are in no window. The same call serves a batch and a stream; the
    ``seconds`` of the aggregates are not used here."""
    w = F.window(F.col(ts), window, slide)
    src = df.withWatermark(ts, delay) if df.isStreaming else df
    state = src.groupBy(*keys, w.alias("w")).agg(*[sketch_state(a).alias(a.name) for a in aggs])
    return state.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                        *[sketch_value(a, F.col(a.name)).alias(a.name) for a in aggs])


def dedup_events(df: DataFrame, id_col: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeated events (J6): state per id lives until the watermark
    passes; copies arriving later than the watermark are late and dropped."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])
    return df.dropDuplicates([id_col])
