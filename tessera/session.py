"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the library depends on for correct results (UTC wall clock, so
# TIMESTAMP and TIMESTAMP_NTZ agree) and for a sane plan at any scale (AQE
# re-plans joins, coalesces small partitions and splits skewed ones).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "tessera",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used as is."""
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
         .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024)))
    for k, v in {**REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_code()
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    ship_code()


def ship_code() -> None:
    """Send this package's functions to Python workers with the tasks that
    use them (pickled by value), so executors need no installed copy."""
    import tessera
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(tessera)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (spark.checkpoint.dir).

    A cluster names a shared folder there. A fresh scratch folder is only made
    for a local master (tests); elsewhere each executor would write to its own
    disk, so a missing setting is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_of(spark: SparkSession, rows: int, rows_per_task: int) -> Iterator[None]:
    """Shuffles of jobs run inside have as many partitions as keep a task at
    about ``rows_per_task`` of ``rows``, and AQE does not merge them again, so
    that what a task holds does not grow with the input. Few rows leave the
    session's settings as they are."""
    n = -(-rows // rows_per_task)
    if n <= spark.sparkContext.defaultParallelism:
        yield
        return
    count, merged = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (count, merged)}
    try:
        spark.conf.set(count, str(max(n, int(before[count]))))
        spark.conf.set(merged, "false")
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# Shuffle files of a job go as soon as it has ended, not when the driver happens
# to collect its garbage; a later Spark may name it otherwise, an earlier one
# does not know it and keeps them.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings that hold for the jobs run inside."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df, name: str):
    """Cut lineage by writing ``df`` once as Parquet under the shared
    checkpoint folder and reading it back (one job; an eager checkpoint()
    would compute the plan a second time to save it). Survives executor
    loss: later stages read the files, not the lost shuffle output, which is
    no longer needed and is dropped."""
    path = scratch_path(df.sparkSession, name)
    with settings(df.sparkSession, {DROP_SHUFFLES: "true"}):
        df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._written = (path,)
    getattr(_made, "tables", []).append(out)
    return out


_made = threading.local()  # tables: what this thread has written since ``distilled`` began


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for p in df._written:
            at = context._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def distilled(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` written by ``materialize``; the tables that were written on
    the way to it are removed."""
    outer, _made.tables = getattr(_made, "tables", []), []
    try:
        out = materialize(make(), name)
        discard(*[t for t in _made.tables if t is not out])
    finally:
        _made.tables = outer
    outer.append(out)
    return out


def sliced(df: DataFrame, key: str, rows_at_once: int, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``make(df)`` written for some rows at a time, dealt by the hash of
    ``key``, so that what is shuffled for some goes before the next ones.
    ``make`` may only put rows of one key together."""
    n = -(-df.count() // rows_at_once)
    if n <= 1:
        return materialize(make(df), name)
    parts = [materialize(make(df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)), name) for i in range(n)]
    out = reduce(DataFrame.unionByName, parts)
    out._written = sum((p._written for p in parts), ())
    return out
