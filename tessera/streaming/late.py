"""Late rows of a stream, kept and counted instead of dropped.

A row of a micro-batch is late if its event time lies before the watermark the
earlier batches left: the largest event time among their rows, less the allowed
delay. Rows without an event time are never late. Three logs grow by appending
(on-time rows, late rows, and the largest event time and counts of each batch);
a batch that is run again replaces its part of each and sees only the batches
before it, so counts stay exact after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming.runner import ChangeLog


class LateRows:
    """Splits micro-batches with columns ``schema`` by the watermark of ``ts``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, ts: str, delay_seconds: int):
        self.ts, self.delay_us = ts, delay_seconds * 1_000_000
        self.on_time = ChangeLog(spark, f"{path}/on-time", schema)
        self.late = ChangeLog(spark, f"{path}/late", schema)
        self.progress = ChangeLog(spark, f"{path}/progress", "batch long, max_us long, n_on_time long, n_late long")

    def write(self, batch: DataFrame, epoch: int) -> None:
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        mark = self.progress.read(before=epoch).agg(F.max("max_us").alias("seen")).first()["seen"]
        is_late = F.lit(False) if mark is None else F.coalesce(us < F.lit(mark - self.delay_us), F.lit(False))
        self.on_time.write(batch.where(~is_late), epoch)
        self.late.write(batch.where(is_late), epoch)
        self.progress.write(batch.agg(F.lit(epoch).cast("long").alias("batch"), F.max(us).alias("max_us"),
                                      F.count_if(~is_late).alias("n_on_time"), F.count_if(is_late).alias("n_late")),
                            epoch)

    def counts(self) -> DataFrame:
        """(batch, n_on_time, n_late)."""
        return self.progress.read().select("batch", "n_on_time", "n_late")
