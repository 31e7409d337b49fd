"""Whole-file sources and the corpus sinks.

Folders of markdown or Python files are read with Spark's ``binaryFile``
source (recursive listing, suffix filter), decoded as UTF-8; a file that is
not valid UTF-8 goes to a rejects output and contributes nothing (A1-A3).
"""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def relative_path(path_col, root: str):
    """Path of a listed file relative to ``root`` (the listing gives URIs)."""
    root = root.rstrip("/")
    return F.regexp_extract(path_col, "^.*?" + re.escape(root).replace("\\/", "/") + "/(.*)$", 1)


def read_text_files(spark: SparkSession, root: str, suffix: str) -> tuple[DataFrame, DataFrame]:
    """All files under ``root`` (recursively) whose name ends with ``suffix``.
    Returns (files, rejects): files = (path, rel_path, content string);
    rejects = (path, reason) for files that are not valid UTF-8."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", f"*{suffix}").load(root)
           .select("path", "content"))
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    files = (raw.filter(ok).select("path", relative_path(F.col("path"), root).alias("rel_path"),
                                   text.alias("content")))
    rejects = raw.filter(~ok).select("path", F.lit("not valid UTF-8").alias("reason"))
    return files, rejects


def read_markdown_tree(spark: SparkSession, root: str):
    """Markdown files (``.md``, not ``.mdx``) of a documentation tree (A1, A3)."""
    return read_text_files(spark, root, ".md")


def read_code_roots(spark: SparkSession, roots: list[tuple[str, str]]):
    """Python files of several roots, each tagged with its kind; a missing
    root is skipped with a warning (A2). Returns (files, rejects) with a
    ``directory_type`` column."""
    files, rejects = None, None
    for path, kind in roots:
        if not _path_exists(spark, path):
            log.warning("Directory %s does not exist, skipping", path)
            continue
        f, r = read_text_files(spark, path, ".py")
        f = f.withColumn("directory_type", F.lit(kind))
        files = f if files is None else files.unionByName(f)
        rejects = r if rejects is None else rejects.unionByName(r)
    if files is None:
        empty = spark.createDataFrame([], "path string, rel_path string, content string, directory_type string")
        return empty, spark.createDataFrame([], "path string, reason string")
    return files, rejects


def write_partitioned(df: DataFrame, path: str, partition_col: str) -> None:
    """One dataset folder per value of ``partition_col`` (doc_version for
    chunks, directory_type for examples). Dynamic overwrite: rewriting one
    version or kind leaves the others in place (A5, A6). Readers take the
    combined set by reading the root, or one part by filtering the column
    (partition pruning). Write errors fail the job."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))


def read_partitioned(spark: SparkSession, path: str, partition_col: str, value: str | None = None) -> DataFrame:
    """Read a dataset written by ``write_partitioned``. The partition value
    stays a string (a version label such as '1.0' must not become a number);
    with ``value`` only that folder is read (partition pruning, A10)."""
    inferred = spark.read.parquet(path).schema
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == partition_col else f
                           for f in inferred.fields])
    df = spark.read.schema(schema).parquet(path)
    return df.filter(F.col(partition_col) == value) if value is not None else df
