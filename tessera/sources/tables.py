"""Readers for the input tables (one Parquet dataset per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# A scan smaller than this is not worth a rebalancing shuffle.
REBALANCE_MIN_BYTES = 2 * 1024 * 1024

_size_cache: dict[str, int] = {}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def _bytes(spark: SparkSession, path: str) -> int:
    if path not in _size_cache:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        _size_cache[path] = int(fs.getContentSummary(p).getLength())
    return _size_cache[path]


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str, balance: bool = True) -> DataFrame:
    """Parquet scan; selecting columns here lets the scan read only those.

    A scan splits at row-group granularity, so a large table stored as a few
    big row groups would leave most cores idle until the first shuffle. When
    the scan has fewer partitions than the cluster has cores and the data is
    large enough to matter, the rows are spread round-robin (one shuffle of
    the selected columns). Real multi-file inputs never take this branch.
    Filters added later still reach the scan (Catalyst pushes them through
    the repartition).
    """
    path = table_path(sf_dir, name)
    df = spark.read.parquet(path)
    if cols:
        df = df.select(*cols)
    if balance:
        par = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par and _bytes(spark, path) >= REBALANCE_MIN_BYTES:
            df = df.repartition(par)
    return df


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view for spark.sql(...) features."""
    for t in TABLES:
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
