"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (decontaminate, language_id, license_scan, line_dedup, oracles, packing, quality_rules,
                         sharding, simhash, spelling_variants, substring_dedup, suffix_dedup, warc, whitening)
from tessera.llm.common import read
from tessera.plans.registry import register
from tessera.session import scratch_path

SHARD_BYTES = 512 * 1024  # splits the given tables many times


@register("op9_quality_rules", oracles.QUALITY_RULES)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    q = docs.select("doc_id", quality_rules.verdicts(F.col("text")).alias("q"))
    return q.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
                    "q.base_failed", "q.kept")


@register("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@register("op4_sharding", oracles.SHARDING.format(limit=SHARD_BYTES))
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), SHARD_BYTES)


@register("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@register("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(read(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def file_tree(docs: DataFrame) -> DataFrame:
    """``documents`` as files: directories by source and decimal digits of the
    id; an id that ends in zeros is the licence file of its directory."""
    i = F.col("doc_id")
    steps = [F.col("source"), *(F.floor(i / n).cast("string") for n in (10_000, 1_000, 100, 10))]
    path = F.concat_ws("/", *steps, F.concat(i.cast("string"), F.lit(".txt")))
    for depth, n in ((5, 10), (4, 100), (3, 1_000), (2, 10_000)):
        path = F.when(i % n == 0, F.concat_ws("/", *steps[:depth], F.lit("LICENSE"))).otherwise(path)
    return docs.select("doc_id", F.when(i.isNotNull(), path).alias("path"), "text")


@register("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(file_tree(read(spark, sf_dir, "documents")), carry=("doc_id",))


@register("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(read(spark, sf_dir, "documents"), out="d")
    return found.select("doc_id", "d.n_lines", "d.n_removed", F.sha2("d.text", 256).alias("kept_sha256"))


@register("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(read(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def slipped_words(docs: DataFrame) -> DataFrame:
    """(word): the letter runs of ``documents``, of which a fixed thirty-first
    part lose a letter. A null id counts as an empty string."""
    found = spelling_variants.runs(docs, min_chars=spelling_variants.MIN_CHARS)
    run = F.col("run")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run))
    found = found.select("run", h.alias("h"), (h % F.length(run)).cast("int").alias("at"))
    less = F.concat(F.substring(run, F.lit(1), F.col("at")), F.substring(run, F.col("at") + 2, F.length(run)))
    return found.select(F.when(F.col("h") % 31 == 0, less).otherwise(run).alias("word"))


@register("op13_spelling_variants", oracles.SPELLING_VARIANTS)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = slipped_words(read(spark, sf_dir, "documents"))
    found = spelling_variants.variants(spelling_variants.vocabulary(words, F.col("word")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@register("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(
        "vec_id", whitening.quantise(F.col("embedding"), 1024, 100_000).alias("x"))
    return whitening.whiten(vectors, "vec_id", "x")


@register("op11_warc", oracles.WARC)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
