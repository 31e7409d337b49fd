"""Incremental stream runs over a folder of files.

A file source picks new files up run after run; each run is a Structured
Streaming query with ``availableNow`` (process what is there, then stop)
sharing one checkpoint, so the runs together behave like one long stream.
Folders live under the session's shared checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.session import scratch_path

ROWS_PER_TASK = 125_000  # of a slice; a row is in several windows


class FileStream:
    """A stream over Parquet files landing in ``input_dir``."""

    def __init__(self, spark: SparkSession, name: str, schema):
        self.spark = spark
        self.base = scratch_path(spark, name)
        self.input_dir = f"{self.base}/input"
        self.checkpoint = f"{self.base}/checkpoint"
        self.sink = f"{self.base}/sink"
        self.schema = schema

    def land(self, df: DataFrame) -> None:
        """New files arrive (append into the input folder)."""
        df.write.mode("append").parquet(self.input_dir)

    def read(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.input_dir)

    def run_append(self, build: Callable[[DataFrame], DataFrame]) -> None:
        """One incremental run: new input -> ``build`` -> appended to the
        Parquet sink (exactly once through the checkpoint)."""
        self._run(build(self.read()).writeStream.format("parquet").outputMode("append").option("path", self.sink))

    def run_foreach_batch(self, build: Callable[[DataFrame], DataFrame],
                          handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
        self._run(build(self.read()).writeStream.foreachBatch(handle).outputMode(mode))

    def _run(self, writer: DataStreamWriter) -> None:
        """Executors go on holding the states of finished runs for a while, so
        each keeps the last version only: what is still open, not all rows."""
        versions = "spark.sql.streaming.maxBatchesToRetainInMemory"
        before = self.spark.conf.get(versions)
        try:
            self.spark.conf.set(versions, "1")
            q = writer.option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            self.spark.conf.set(versions, before)
        if q.exception():
            raise q.exception()

    def read_sink(self) -> DataFrame:
        return self.spark.read.parquet(self.sink)


def time_slices(df: DataFrame, ts: str, n: int) -> list[DataFrame]:
    """Cut a table into ``n`` consecutive event-time ranges (to land in
    order, as a live feed would)."""
    lo, hi = df.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))),
                    F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()
    if lo is None:
        return []
    step = (hi - lo) // n + 1
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return [df.filter((t >= lo + i * step) & (t < lo + (i + 1) * step)) for i in range(n)]


def bounded_slices(df: DataFrame, ts: str, n: int, path: str, rows_per_task: int | None = None) -> list[DataFrame]:
    """Consecutive event-time ranges of about equal numbers of rows: ``n``, or
    more if a run's tasks would take in more than ``rows_per_task`` rows each.
    A stream over them holds the groups of one slice and its open windows,
    however long the table is. The rows are dealt once, under ``path``, so that
    a slice reads its own files only. Rows of one instant stay in one slice;
    rows without an event time are in none."""
    spark = df.sparkSession
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows_per_task = rows_per_task or ROWS_PER_TASK
    rows = df.where(at.isNotNull())
    total = rows.count()
    if not total:
        return []
    tasks = spark.sparkContext.defaultParallelism
    n = max(n, -(-total // (rows_per_task * min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    cuts = rows.select(at.alias("_at")).approxQuantile("_at", [i / n for i in range(1, n)], 0.2 / n)
    split = Bucketizer(splits=[-math.inf, *sorted(set(cuts)), math.inf], inputCol="_at", outputCol="_slice")
    dealt = (split.transform(rows.withColumn("_at", at.cast("double"))).withColumn("_slice", F.col("_slice").cast("int"))
             .withColumn("_deal", F.pmod(F.xxhash64(*df.columns), F.lit(tasks))))
    (dealt.repartition(n * tasks, "_slice", "_deal").drop("_at", "_deal").write.partitionBy("_slice")
     .option("maxRecordsPerFile", rows_per_task).parquet(path))
    read = spark.read.schema(df.select("*", F.lit(0).alias("_slice")).schema).parquet(path)
    return [read.where(F.col("_slice") == i).select(df.columns) for i in range(len(set(cuts)) + 1)]


class ChangeLog:
    """Rows of keyed updates, appended batch by batch: one folder per
    micro-batch, and a batch that is run again replaces its own folder. Earlier
    batches are never rewritten; readers take the latest row of a key
    (``latest_per_key``). With a ``schema`` the log can be read before the
    first batch, or if all batches are empty."""

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None):
        self.spark, self.path = spark, path
        self.schema = f"{schema}, epoch long" if schema else None
        if schema:
            spark.createDataFrame([], schema).write.mode("append").parquet(path)

    def write(self, batch: DataFrame, epoch: int) -> None:
        (batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(self.path))

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of the batches before one."""
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        rows = reader.parquet(self.path)
        return (rows if before is None else rows.where(F.col("epoch") < before)).drop("epoch")
