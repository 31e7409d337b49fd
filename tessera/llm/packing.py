"""Packing: optimal length buckets from a dynamic programme over the global
length histogram, and token-budget batches inside each bucket.

A document of more than ``max_len`` tokens is cut into consecutive pieces of
``max_len``; the rest is one shorter piece. So a histogram has at most
``max_len`` entries, whatever the data, and that histogram is all the driver
sees. Batches are numbered by a distributed count: pieces are dealt to
(bucket, slice) groups of bounded size by a hash (equal rows that are too many
for one by their row numbers), counted, and numbered from
the running total of the slices before theirs; only the last batch of a
bucket may be short. No task holds a bucket.

Edge cases. A null or wordless text has no tokens and yields no piece. A
document repeated as a row is packed once per row (pieces of equal rows are
interchangeable). Ties are ordered by (hash, doc_id, piece), nulls first. An
empty table gives an empty result and no bucket. Only the named columns are
read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import words
from tessera.session import materialize

# Pieces in one numbering group; a bucket is dealt to as many slices as it needs.
SLICE_PIECES = 20_000


@dataclass(frozen=True)
class PackingConfig:
    max_len: int = 4096          # longest piece, in tokens
    n_buckets: int = 16          # padded lengths in use
    batch_tokens: int = 65_536   # padded tokens of one batch (>= max_len)


def token_count(text: Column) -> Column:
    """Tokens of a text: its words. Any other count may be passed instead."""
    return F.size(words(text))


def optimal_boundaries(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """At most ``n_buckets`` padded lengths of least total padding.

    cost(i, j) pads lengths i+1..j (of the sorted distinct lengths) to the
    j-th: best[k][j] = min over i of best[k-1][i] + cost(i, j)."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    n = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    rows = np.concatenate(([0], np.cumsum(n)))
    m, k_max = len(lengths), min(n_buckets, len(lengths))
    # Tokens are the same in every plan, so padded size stands for padding.
    best = np.full(m + 1, np.iinfo(np.int64).max // 4, dtype=np.int64)
    best[0] = 0
    back = np.zeros((k_max + 1, m + 1), dtype=np.int64)
    for k in range(1, k_max + 1):
        new = best.copy()
        back[k] = np.arange(m + 1)  # "no bucket spent here"
        for j in range(1, m + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1]
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], back[k][j] = cost[i], i
        best = new
    out, j = [], m
    for k in range(k_max, 0, -1):
        i = int(back[k][j])
        if i != j:
            out.append(int(lengths[j - 1]))
            j = i
    return sorted(out)


def pieces(docs: DataFrame, config: PackingConfig, id_col: str = "doc_id", text_col: str = "text",
           n_tokens: Column | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, piece, start, n_tokens, h) of every document; h is a hash of
    its id, its text and the piece's number. With ``texts`` also the words of
    each piece, joined by one space."""
    source = F.col(f"`{text_col}`")
    n = token_count(source) if n_tokens is None else n_tokens
    cap = F.lit(config.max_len)
    counted = docs.select(F.col(f"`{id_col}`").alias("doc_id"), n.cast("long").alias("n"),
                          F.xxhash64(source).alias("of_text"), source.alias("text")).where("n > 0")
    start = F.col("piece") * cap
    text = F.array_join(F.slice(words(F.col("text")), (start + 1).cast("int"), cap), " ")
    return (counted.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / cap).cast("int"))))
            .select("doc_id", "piece", start.cast("long").alias("start"),
                    F.least(cap, F.col("n") - start).cast("int").alias("n_tokens"),
                    F.xxhash64("doc_id", "of_text", "piece").alias("h"), *([text.alias("text")] if texts else [])))


def _dealt_by(cut: DataFrame, most: int) -> DataFrame:
    """``cut`` with ``deal``, by which a piece gets its slice: ``h``, but for the
    pieces of more than ``most`` equal rows a hash of their row numbers, as
    these rows can stand for each other."""
    heavy = cut.groupBy("h").count().where(F.col("count") > most).select("h", F.lit(True).alias("heavy"))
    return cut.join(heavy, "h", "left").withColumn(
        "deal", F.when(F.col("heavy"), F.xxhash64("h", "row")).otherwise(F.col("h"))).drop("heavy")


def pack(docs: DataFrame, config: PackingConfig | None = None, id_col: str = "doc_id", text_col: str = "text",
         n_tokens: Column | None = None, texts: bool = False) -> DataFrame:
    """Pieces with their bucket length, batch and slot.

    Columns: doc_id, piece, start, n_tokens, bucket_len, batch_id (number in
    the bucket), slot (place in the batch); with ``texts`` also text (the words
    of the piece; they are written once and shuffled once, by row number). A batch of bucket length b holds
    batch_tokens // b pieces."""
    config = config or PackingConfig()
    if config.batch_tokens < config.max_len:
        raise ValueError("batch_tokens must be at least max_len")
    spark = docs.sparkSession
    written = materialize(pieces(docs, config, id_col, text_col, n_tokens, texts).withColumn(
        "row", F.monotonically_increasing_id()), "packing-pieces")
    cut = written.drop("text")
    histogram = {r["n_tokens"]: r["n"] for r in cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    bounds = optimal_boundaries(histogram, config.n_buckets)
    in_bucket = {b: 0 for b in bounds}
    for length, n in histogram.items():
        in_bucket[next(b for b in bounds if length <= b)] += n
    table = spark.createDataFrame(
        [(b, max(1, -(-in_bucket[b] // SLICE_PIECES)), config.batch_tokens // b) for b in bounds],
        "bucket_len int, n_slices long, per_batch long")
    bucket = F.lit(None).cast("int")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    dealt = (_dealt_by(cut, SLICE_PIECES).withColumn("bucket_len", bucket).join(F.broadcast(table), "bucket_len")
             .withColumn("slice", F.pmod("deal", "n_slices")))
    counts = dealt.groupBy("bucket_len", "slice").agg(F.count("*").alias("n_in"))
    before = counts.select("bucket_len", "slice", (F.sum("n_in").over(
        Window.partitionBy("bucket_len").orderBy("slice")) - F.col("n_in")).alias("before"))
    order = Window.partitionBy("bucket_len", "slice").orderBy("h", F.col("doc_id").asc_nulls_first(), "piece")
    numbered = (dealt.withColumn("rn", F.row_number().over(order))
                .join(before, ["bucket_len", "slice"])
                .withColumn("at", F.col("before") + F.col("rn") - 1))
    out = numbered.select("row", "doc_id", "piece", "start", "n_tokens", "bucket_len",
                          F.floor(F.col("at") / F.col("per_batch")).cast("long").alias("batch_id"),
                          F.pmod(F.col("at"), F.col("per_batch")).cast("int").alias("slot"))
    if texts:  # the slim side is hashed, so that texts are not sorted
        out = out.hint("shuffle_hash").join(written.select("row", "text"), "row")
    return out.drop("row")
