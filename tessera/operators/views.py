"""Feature definitions: sources, feature views and services.

A view is a function on DataFrames plus its keys, event time and windowed
aggregates. The same view computes a backfill on a batch DataFrame, live
values on a streaming one (J4), offline materialisation by period (H15,
H16), point-in-time training rows (E11) and online latest values (J2, H17).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.features import WindowAgg, asof_join, latest_per_key, range_window_features
from tessera.streaming.features import sliding_aggregates, windowed_aggregates, with_event_time


@dataclass
class BatchSource:
    """A table with a declared event-time column."""
    name: str
    path: str
    timestamp_field: str
    format: str = "parquet"

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.format).load(self.path)


@dataclass
class StreamSource:
    """A stream feeding views (A13): any Structured Streaming source format
    (files here; a message-bus format takes its options the same way)."""
    name: str
    schema: T.StructType
    timestamp_field: str
    format: str = "parquet"
    path: str | None = None
    options: dict = field(default_factory=dict)

    def read_stream(self, spark: SparkSession) -> DataFrame:
        r = spark.readStream.format(self.format).schema(self.schema).options(**self.options)
        return r.load(self.path) if self.path else r.load()


def pandas_transform(fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> Callable[[DataFrame], DataFrame]:
    """A user transformation written for pandas (mode='pandas', K4), run on
    Arrow batches of each partition with ``mapInPandas``."""
    def run(df: DataFrame) -> DataFrame:
        return df.mapInPandas(lambda it: (fn(pdf) for pdf in it), schema)
    return run


@dataclass
class FeatureView:
    """Transform + entity keys + event time + optional windowed aggregates."""
    name: str
    keys: list[str]
    timestamp_field: str
    transform: Callable[[DataFrame], DataFrame] = lambda df: df
    aggregations: list[WindowAgg] = field(default_factory=list)
    feature_start_time: str | None = None
    ttl_seconds: int | None = None
    batch_schedule: str = "day"
    description: str = ""

    def _input(self, df: DataFrame) -> DataFrame:
        out = self.transform(df)
        if self.feature_start_time:
            start = F.lit(self.feature_start_time).cast(out.schema[self.timestamp_field].dataType)
            out = out.filter(F.col(self.timestamp_field) >= start)   # B8; reaches the scan
        return out

    def _keyed(self, df: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, str]:
        """``df`` and the one column that stands for all keys: the key itself,
        or a struct of them (``names``: what the frame calls them)."""
        names = names or self.keys
        if names == self.keys and len(self.keys) == 1:
            return df, self.keys[0]
        return df.withColumn("_key", F.struct(*(F.col(n).alias(k) for n, k in zip(names, self.keys, strict=True)))), "_key"

    def _unkeyed(self, df: DataFrame, key: str) -> DataFrame:
        if key != "_key":
            return df
        rest = [c for c in df.columns if c != "_key" and c not in self.keys]
        return df.select("_key.*", *rest)

    def features(self, df: DataFrame) -> DataFrame:
        """Batch values: one row per input row with every aggregate over its
        (t - w, t] window per key (H7-H10)."""
        return self._features(self._input(df))

    def _features(self, out: DataFrame) -> DataFrame:
        if not self.aggregations:
            return out
        keyed, key = self._keyed(out)
        res = range_window_features(keyed, key, self.timestamp_field, self.aggregations)
        return res.drop("_key") if key == "_key" else res

    def stream_features(self, stream_df: DataFrame, value: str, window: str = "1 hour",
                        slide: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
        """Live sliding-window count and sum per key (J1); the batch form of
        the same call on a batch DataFrame gives the backfill."""
        src = self._input(with_event_time(stream_df, self.timestamp_field) if stream_df.isStreaming
                          else stream_df)
        keyed, key = self._keyed(src)
        return self._unkeyed(sliding_aggregates(keyed, key, self.timestamp_field, value, window, slide, delay), key)

    def window_aggregates(self, df: DataFrame, seconds: int, slide: str = "10 minutes",
                          delay: str = "10 minutes") -> DataFrame:
        """The view's own aggregations of one window length, per key and
        sliding window (J1, J4): live on a streaming ``df``, the backfill on a
        batch one, by the same plan. Lengths differ in their state, so a view
        with several has one stream for each."""
        aggs = [a for a in self.aggregations if a.seconds == seconds]
        if not aggs:
            raise ValueError(f"view {self.name} has no aggregation over {seconds} seconds")
        src = self._input(with_event_time(df, self.timestamp_field) if df.isStreaming else df)
        return windowed_aggregates(src, self.keys, self.timestamp_field, aggs, f"{seconds} seconds", slide, delay)

    def materialize(self, df: DataFrame, path: str, start: str | None = None, end: str | None = None) -> None:
        """Offline store by period (H15, H16): rows in [start, end) are
        computed and written, one folder per period; a re-run replaces only
        the periods it covers (dynamic partition overwrite). Of the source only
        [start - largest window, end) is read."""
        out = self._input(df)
        ts, kind = F.col(self.timestamp_field), out.schema[self.timestamp_field].dataType
        first, last = (F.lit(x).cast(kind) if x else None for x in (start, end))
        if last is not None:
            out = out.filter(ts < last)
        if first is not None:
            reach = max((a.seconds for a in self.aggregations), default=0)
            out = out.filter(ts >= first - F.expr(f"INTERVAL {int(reach)} SECONDS"))
        out = self._features(out)
        if first is not None:
            out = out.filter(ts >= first)
        out = out.withColumn("period", F.date_trunc(self.batch_schedule, ts).cast("date"))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("period").parquet(path))

    def online(self, df: DataFrame, value_cols: list[str], tie_col: str) -> DataFrame:
        """Latest value per key (J2), null when older than the ttl relative
        to the latest event time (H17, J3)."""
        out = self._input(df)
        keyed, key = self._keyed(out)
        lat = self._unkeyed(latest_per_key(keyed, key, self.timestamp_field, tie_col, value_cols), key)
        if self.ttl_seconds is None:
            return lat
        us = F.unix_micros(F.col(self.timestamp_field).cast("timestamp"))
        edge = out.select(F.max(F.unix_micros(F.col(self.timestamp_field).cast("timestamp")))).scalar()
        fresh = us > edge - F.lit(self.ttl_seconds * 1_000_000)
        return lat.select(*self.keys, self.timestamp_field, tie_col,
                          *[F.when(fresh, F.col(c)).alias(c) for c in value_cols])

    def training_rows(self, spine: DataFrame, df: DataFrame, value_cols: list[str], tie_col: str) -> DataFrame:
        """Point-in-time values for every spine row."""
        if self.ttl_seconds is None:
            raise ValueError("a ttl bounds how far back a value counts; set ttl_seconds")
        data, key = self._keyed(self._input(df))
        rows, _ = self._keyed(spine)
        found = asof_join(rows, data, key, self.timestamp_field, value_cols, self.ttl_seconds, tie_col)
        return found.drop("_key") if key == "_key" else found


@dataclass
class FeatureService:
    """Several views side by side (E13): each view's columns are prefixed
    with its name; ``key_overrides`` maps a view's key to a spine column."""
    name: str
    views: list[tuple[FeatureView, DataFrame, list[str]]]
    key_overrides: dict[str, dict[str, str]] = field(default_factory=dict)

    def lookup(self, spine: DataFrame, tie_col: str = "event_id") -> DataFrame:
        """Online lookup of the latest values per key."""
        out = spine
        for view, data, cols in self.views:
            vals = view.online(data, cols, tie_col)
            named = {k: f"_{view.name}_{k}" for k in view.keys}
            vals = vals.select(*[F.col(k).alias(n) for k, n in named.items()],
                               *[F.col(c).alias(f"{view.name}__{c}") for c in cols])
            renamed = self.key_overrides.get(view.name, {})
            same = [out[renamed.get(k, k)] == vals[n] for k, n in named.items()]
            out = out.join(vals, same, "left").drop(*named.values())
        return out
