"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash. It starts
with one bucket; a bucket over the byte limit splits on its next bit, others
stay as they are, until every bucket fits. The splits are decided on a
histogram of hash prefixes, ``STEP_BITS`` bits at a time, so documents are
read once and only small (id, hash, bytes) rows are grouped again: 2^12 sums
in the first round, and afterwards 2^12 per prefix that is still too large.

Edge cases. A null text has 0 bytes; a null id is hashed as one. Equal rows
(same id and text) share the first 128 hash bits; a row number of the written
table gives the bits after these, so even a third of all rows being one row
splits. A document larger than the limit gets a shard of its own
(``oversized``). An empty table gives no shards. Only the named columns are
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

STEP_BITS = 12
_HEX = STEP_BITS // 4
MAX_BITS = 192  # 128 of the content hash, 64 of the row number's


def _hashed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    key = F.col(f"`{id_col}`").cast("string")
    text = F.col(f"`{text_col}`")
    content = F.md5(F.concat_ws(":", F.coalesce(key, F.lit("null")), F.coalesce(text, F.lit(""))))
    row = F.lpad(F.lower(F.hex(F.xxhash64(F.monotonically_increasing_id()))), 16, "0")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.concat(content, row).alias("hash"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), *carry)


def assign(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text",
           carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, hash, n_bytes, depth, shard, oversized, columns of ``carry``)
    of every document.

    ``shard`` is the bucket's prefix as a string of ``depth`` bits; a table
    that fits the limit as it is has the one shard '' of depth 0."""
    rows = materialize(_hashed(docs, id_col, text_col, carry), "sharding-hashes")
    open_rows, done = rows, []
    for base in range(0, MAX_BITS, STEP_BITS):
        prefix = F.substring("hash", 1, base // 4 + _HEX)
        last = base + STEP_BITS >= MAX_BITS
        leaves = materialize(_directory(open_rows.withColumn("prefix", prefix), base, limit_bytes, last),
                             "sharding-directory")
        placed = open_rows.withColumn("prefix", prefix).join(leaves, "prefix")
        done.append(placed.where("depth is not null"))
        if leaves.where("depth is null").isEmpty():
            break
        open_rows = materialize(placed.where("depth is null").select(rows.columns), "sharding-open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", F.substring("hash", 1, 32).alias("hash"), "n_bytes", "depth",
                      F.concat(F.array_join(F.transform(F.split(F.substring("hash", F.lit(1), F.ceil(F.col("depth") / 4)
                                                                             .cast("int")), ""),
                                                        lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), ""))
                      .alias("bits"), "oversized", *carry).select(
        "doc_id", "hash", "n_bytes", "depth",
        F.expr("case when depth = 0 then '' else substring(bits, 1, depth) end").alias("shard"), "oversized", *carry)


def _directory(rows: DataFrame, base: int, limit: int, last: bool) -> DataFrame:
    """(prefix, depth, oversized): for every hash prefix of base + STEP_BITS
    bits the least depth whose bucket fits, or null if a deeper one is needed.

    Every bucket at ``base`` is too large (or it is the whole table)."""
    fine = rows.groupBy("prefix").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    bits = F.conv(F.substring("prefix", -_HEX, _HEX), 16, 10).cast("int")
    parent = F.expr(f"substring(prefix, 1, {base // 4})")
    levels = fine.select("prefix", "bytes", "n", parent.alias("parent"), bits.alias("bits"),
                         F.explode(F.sequence(F.lit(0), F.lit(STEP_BITS))).alias("d")).withColumn(
        "bucket", F.expr(f"shiftright(bits, {STEP_BITS} - d)"))
    sums = levels.groupBy("parent", "d", "bucket").agg(F.sum("bytes").alias("in_bucket"), F.sum("n").alias("rows_in"))
    fits = (F.col("in_bucket") <= limit) | (F.col("rows_in") == 1)
    if last:
        fits = fits | (F.col("d") == STEP_BITS)
    leaf = levels.join(sums, ["parent", "d", "bucket"]).groupBy("prefix").agg(
        F.min(F.when(fits, F.col("d"))).alias("d"),
        F.min_by("in_bucket", F.when(fits, F.col("d"))).alias("in_bucket"))
    return leaf.select("prefix", (F.col("d") + base).alias("depth"), (F.col("in_bucket") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write ``docs`` as one folder per shard and return the name of the folder
    column: ``shard``, behind as many underscores as it takes to clash with no
    column. Rows go by a number of their own, so ids may repeat or be null; a
    folder is named b and the shard's bits."""
    number = _free("__row", docs)
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "sharding-rows")
    name = _free("shard", docs)
    shards = assign(numbered, limit_bytes, id_col, text_col, carry=(number,)).select(
        number, F.concat(F.lit("b"), F.col("shard")).alias(name))
    numbered.join(shards, number).drop(number).repartition(name).write.partitionBy(name).parquet(path)
    return name


def _free(name: str, df: DataFrame) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
