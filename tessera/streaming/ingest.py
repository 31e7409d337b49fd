"""Ingest of new documents into a chunk index, batch by batch.

A micro-batch is cut into sections and chunks, and its new chunks into terms.
Three logs grow by appending: chunks (under the md5 of their text), terms of
chunks, and document frequencies as the change each batch makes. Vectors are
weighed on read from the terms and the merged frequencies, so nothing is
tokenised or fitted again when the corpus grows, and they equal those of a
build over all documents at once. A batch that is run again replaces its part
of each log and looks only at the batches before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.embed import HashingEmbedder, term_counts
from tessera.operators.features import latest_per_key
from tessera.operators.sections import chunk_sections, markdown_sections
from tessera.session import materialize
from tessera.streaming.runner import ChangeLog


class ChunkIndex:
    """Chunks, terms and document frequencies under ``path``. ``id_type``:
    type of the documents' id; a larger id is newer, none is oldest."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long"):
        self.rows = ChangeLog(spark, f"{path}/chunks", f"id string, doc_id {id_type}, section_no long, header string, "
                                                       "word_length int")
        self.terms = ChangeLog(spark, f"{path}/terms", "id string, tok string, tf long")
        self.frequencies = ChangeLog(spark, f"{path}/frequencies", "tok string, df long")

    def write(self, batch: DataFrame, epoch: int, doc_id: str = "doc_id", text: str = "text") -> None:
        """Take in a micro-batch of documents. Sections belong to a row of the
        batch, whatever its id: rows without one, or with the same, stay apart."""
        rows = batch.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("content")).where(
            F.col("content").isNotNull())
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "ingest-batch")
        cut = chunk_sections(markdown_sections(rows, "row", "content")).join(rows.select("row", "doc_id"), "row")
        cut = materialize(cut.select(F.md5("text_chunk").alias("id"), "doc_id", "section_no", "header",
                                     F.col("word_length").cast("int").alias("word_length"), "text_chunk"),
                          "ingest-chunks")
        seen = self.rows.read(before=epoch).select("id").distinct()
        new = cut.select("id", "text_chunk").dropDuplicates(["id"]).join(seen, "id", "left_anti")
        found = materialize(term_counts(new, "id", "text_chunk"), "ingest-terms")
        self.terms.write(found, epoch)
        self.frequencies.write(found.groupBy("tok").agg(F.count("*").alias("df")), epoch)
        self.rows.write(latest_per_key(cut, "id", "doc_id", "section_no", ["header", "word_length"]), epoch)

    def chunks(self) -> DataFrame:
        """The newest row of every chunk text."""
        return latest_per_key(self.rows.read(), "id", "doc_id", "section_no", ["header", "word_length"])

    def vectors(self, embedder: HashingEmbedder) -> DataFrame:
        """(id, bucket, value) of every chunk with a token."""
        terms = self.terms.read()
        model = embedder.model(self.frequencies.read().groupBy("tok").agg(F.sum("df").alias("df")),
                               terms.select(F.count_distinct("id")).scalar())
        return model.transform_terms_sparse(terms, "id")
