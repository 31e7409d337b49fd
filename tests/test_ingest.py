"""The chunk index built batch by batch against one build over all documents."""
from pyspark.sql import functions as F

from tessera.operators.embed import HashingEmbedder, term_counts
from tessera.operators.sections import chunk_sections, markdown_sections
from tessera.streaming.ingest import ChunkIndex

WORDS = "one two three four five six seven eight nine ten eleven"
DOCS = [(1, f"# First\n{WORDS}\n# Second\n{WORDS} twelve"), (2, f"# First\n{WORDS}"), (None, f"# Other\n{WORDS} thirteen"),
        (None, f"# Own\n{WORDS} fourteen"), (3, None), (4, ""), (5, "too short"), (2, f"# More\n{WORDS} again"),
        (9, f"# First\n{WORDS}")]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def vectors(df):
    return sorted((r.id, r.bucket, round(r.value, 9)) for r in df.collect())


def test_batches_equal_one_build(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "a"))
    for epoch, at in enumerate((slice(0, 3), slice(3, 3), slice(3, 8), slice(8, 9))):
        index.write(table(spark, DOCS[at]), epoch)
    index.write(table(spark, DOCS[3:8]), 2)  # a batch that is run again
    rows = table(spark, [r for r in DOCS if r[1] is not None]).withColumn("row", F.monotonically_increasing_id())
    cut = chunk_sections(markdown_sections(rows, "row", "text")).select(F.md5("text_chunk").alias("id"), "text_chunk")
    terms = term_counts(cut.dropDuplicates(["id"]), "id", "text_chunk")
    embedder = HashingEmbedder(32)
    want = embedder.fit_terms(terms, "id").transform_terms_sparse(terms, "id")
    assert vectors(index.vectors(embedder)) == vectors(want)
    got = {r.header: r.doc_id for r in index.chunks().collect()}
    assert got == {"# First": 9, "# Second": 1, "# Other": None, "# Own": None, "# More": 2}


def test_empty_index(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "a"))
    index.write(table(spark, []), 0)
    assert index.chunks().collect() == [] and index.vectors(HashingEmbedder(32)).collect() == []
