"""Markdown sectioning and chunking (corpus preparation).

Lines come from ``posexplode`` of the document; fence state and section
numbers are running sums over a window partitioned by document (no global
sort), and the per-section text is rebuilt by a grouped, position-ordered
``array_join``. The group-by key contains the window's partition key, so the
aggregation reuses the window's hash partitioning: one shuffle in total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import lstrip_ws, split_lines, trim_ws, with_sanitized_links, word_count

MIN_WORDS = 10  # fixed value: chunks with fewer words are dropped


def markdown_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "content") -> DataFrame:
    """Cut documents into top-level ``#`` sections.

    A line whose left-stripped form starts with three back-ticks toggles a
    fence and stays in the current section; outside fences a line whose
    left-stripped form is ``#`` or starts with ``# `` opens a section. Text
    before the first header is a section without header. Section text is the
    header line plus its lines, stripped; empty sections are dropped.
    Returns ``(doc_id, section_no, header, text)``; header is null for a
    preamble.
    """
    lines = docs.select(doc_id, F.posexplode(split_lines(text)).alias("pos", "line"))
    s = lstrip_ws("line")
    lines = lines.select(doc_id, "pos", "line",
                         s.startswith("```").alias("is_fence"),
                         ((s == "#") | s.startswith("# ")).alias("hdr_syntax"))
    w = Window.partitionBy(doc_id).orderBy("pos")
    fences_before = F.coalesce(
        F.sum(F.col("is_fence").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    lines = lines.withColumn("is_header", ~F.col("is_fence") & (fences_before % 2 == 0)
                             & F.col("hdr_syntax"))
    lines = lines.withColumn("section_no", F.sum(F.col("is_header").cast("long")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    sec = lines.groupBy(doc_id, "section_no").agg(
        F.max(F.when(F.col("is_header"), F.col("line"))).alias("header_raw"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))),
                                 lambda x: x["line"]), "\n").alias("raw"))
    return (sec.select(doc_id, "section_no", trim_ws("header_raw").alias("header"),
                       trim_ws("raw").alias("text"))
            .filter(F.col("text") != ""))


def chunk_sections(sections: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Clean links, count words after cleaning, drop short chunks; header
    defaults to 'N/A'. Adds ``text_chunk``, ``word_length`` and ``header``."""
    out = (with_sanitized_links(sections, "text", "text_chunk")
           .withColumn("word_length", word_count("text_chunk"))
           .withColumn("header", F.coalesce(F.col("header"), F.lit("N/A"))))
    return out.filter(F.col("word_length") >= min_words)
