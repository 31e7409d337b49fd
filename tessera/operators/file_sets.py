"""Folders of files as partitioned data sets: documentation chunks by version,
code examples by kind."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import doc_url
from tessera.operators.examples import extract_examples
from tessera.operators.sections import chunk_sections, markdown_sections
from tessera.sources.files import read_code_roots, read_markdown_tree, write_partitioned


@dataclass(frozen=True)
class DocSet:
    """One version of the documentation: its label, folder and web address."""
    version: str
    root: str
    base_url: str


def read_doc_sets(spark: SparkSession, sets: list[DocSet]) -> tuple[DataFrame, DataFrame]:
    """Markdown files of all versions and the rejected ones (A1, A3, D3):
    (doc_version, base_url, path, rel_path, content) and (doc_version, path, reason)."""
    files, rejects = [], []
    for s in sets:
        f, r = read_markdown_tree(spark, s.root)
        files.append(f.select(F.lit(s.version).alias("doc_version"), F.lit(s.base_url).alias("base_url"), "path",
                              "rel_path", "content"))
        rejects.append(r.select(F.lit(s.version).alias("doc_version"), "path", "reason"))
    return reduce(DataFrame.unionByName, files), reduce(DataFrame.unionByName, rejects)


def doc_chunks(files: DataFrame) -> DataFrame:
    """Chunks of the files of ``read_doc_sets``, with the address of their
    page, the md5 of their text as id, and their version (B2, C2, D1)."""
    # the file's path names it within all versions
    chunks = chunk_sections(markdown_sections(files, "path", "content"))
    about = files.select("path", "doc_version", "rel_path", "base_url")
    return chunks.join(about, "path").select(
        "doc_version", "text_chunk", "header", doc_url("rel_path", F.col("base_url")).alias("url"),
        F.col("rel_path").alias("source_file"), F.col("word_length").cast("int").alias("word_length"),
        F.md5("text_chunk").alias("id"))


def write_doc_chunks(spark: SparkSession, sets: list[DocSet], path: str) -> DataFrame:
    """Write the chunks of ``sets`` under ``path``, one folder a version; other
    versions there stay as they are (A5). Returns the rejected files."""
    files, rejects = read_doc_sets(spark, sets)
    write_partitioned(doc_chunks(files), path, "doc_version")
    return rejects


def write_code_examples(spark: SparkSession, roots: list[tuple[str, str]], path: str, extractor=None) -> DataFrame:
    """Write the labelled examples of the code files under ``roots`` (folder,
    kind), one folder a kind, repeated ones included (A2, A6, B1, B5). Readers
    of ``path`` get the united set (I4). Returns the rejected files."""
    files, rejects = read_code_roots(spark, roots)
    write_partitioned(extract_examples(files, extractor).select("text", "code", "directory_type"), path,
                      "directory_type")
    return rejects
