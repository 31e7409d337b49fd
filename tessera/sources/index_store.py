"""Vector index tables on Parquet, with a one-row manifest beside them.

Index rows: ``(id string, text string, vector array<double>, metadata struct)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

DEFAULT_MODEL = "hash-64"  # fixed value: model assumed when no manifest exists


def manifest_path(index_path: str) -> str:
    return index_path.rstrip("/") + "_manifest"


def write_manifest(spark: SparkSession, index_path: str, model: str, version: str | None = None) -> None:
    """One-row JSON dataset: embedding model and source version."""
    spark.createDataFrame([(model, version)], "embedding_model string, source_version string") \
        .coalesce(1).write.mode("overwrite").json(manifest_path(index_path))


def read_manifest(spark: SparkSession, index_path: str) -> dict:
    """The manifest as a dict; ``{}`` when absent."""
    try:
        row = spark.read.schema("embedding_model string, source_version string") \
            .json(manifest_path(index_path)).first()
    except AnalysisException:
        return {}
    return row.asDict() if row else {}


def index_model(spark: SparkSession, index_path: str) -> str:
    return read_manifest(spark, index_path).get("embedding_model") or DEFAULT_MODEL


def build_index(rows: DataFrame, text_col: str, vectors: DataFrame, metadata_cols: list[str],
                id_col: str | None = None) -> DataFrame:
    """Index rows from texts, their vectors ``(id, vector)`` and metadata.
    The id defaults to the md5 of the text; metadata may be empty (A8)."""
    idc = F.col(id_col).cast("string") if id_col else F.md5(F.col(text_col))
    meta = F.struct(*[F.col(c) for c in metadata_cols]) if metadata_cols else F.struct()
    base = rows.select(idc.alias("id"), F.col(text_col).alias("text"), meta.alias("metadata"))
    return base.join(vectors, "id")


def write_index(spark: SparkSession, index: DataFrame, index_path: str, model: str,
                version: str | None = None) -> None:
    """Rebuild: the index folder is replaced as a whole."""
    index.write.mode("overwrite").parquet(index_path)
    write_manifest(spark, index_path, model, version)


def upsert_index(current: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Add rows; a new row replaces an existing one with the same id. Of
    several new rows with one id the one of largest content hash stays."""
    both = current.withColumn("_v", F.lit(0)).unionByName(new_rows.withColumn("_v", F.lit(1)))
    cols = [c for c in current.columns if c != "id"]
    # max_by reduces map-side: an id repeated many times is not one hot task
    return (both.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("_v", F.xxhash64(*cols))).alias("_b"))
            .select("id", "_b.*"))


def load_index(spark: SparkSession, index_path: str, model: str | None = None) -> DataFrame:
    """Read an index; a missing one is an error telling to build it first
    (A11); the requested model must be the one that built it (F8)."""
    try:
        df = spark.read.parquet(index_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"Index not found at {index_path}. Build it first "
                                    "(tessera.sources.index_store.write_index).") from e
        raise
    built_with = index_model(spark, index_path)
    if model is not None and model != built_with:
        raise ValueError(f"index {index_path} was built with {built_with!r}, not {model!r}")
    return df
