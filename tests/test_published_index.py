"""Upserts by bucket: rows, untouched folders, atomic publishing, errors."""
import pytest
from pyspark.sql import functions as F

from tessera.operators.retrieve import search
from tessera.sources.published_index import PublishedIndex

ROW = "id string, text string, vector array<double>, metadata struct<lang: string, n: int>"


def rows(spark, *ids, text="t", lang="en"):
    return spark.createDataFrame([(i, f"{text}{i}", [1.0, float(len(i))], (lang, 1)) for i in ids], ROW)


def test_upsert_replaces_only_touched_buckets(spark, tmp_path):
    ix = PublishedIndex(spark, str(tmp_path / "ix"), n_buckets=8)
    with pytest.raises(FileNotFoundError):
        ix.read()
    first = ix.upsert(rows(spark, *"abcdefgh"), "hash-2", "1.0")
    before = ix.read("hash-2")
    second = ix.upsert(rows(spark, "a", "z", "z", text="new"))
    changed = {b for b in second["buckets"] if second["buckets"][b] != first["buckets"].get(b)}
    assert 1 <= len(changed) <= 2 and second["number"] == 2 and second["source_version"] == "1.0"
    got = {r.id: (r.text, r.metadata.lang) for r in ix.read().collect()}
    assert got == {**{c: (f"t{c}", "en") for c in "bcdefgh"}, "a": ("newa", "en"), "z": ("newz", "en")}
    # a reader of the old version still sees all of it
    assert {r.text for r in before.collect()} == {f"t{c}" for c in "abcdefgh"}


def test_a_taken_number_fails_and_leaves_the_index(spark, tmp_path):
    ix = PublishedIndex(spark, str(tmp_path / "ix"), n_buckets=2)
    one = ix.upsert(rows(spark, "a"))
    with pytest.raises(Exception, match="exist"):
        ix._publish({**one, "buckets": {}})
    assert ix.read().count() == 1
    with pytest.raises(ValueError, match="was built with"):
        ix.upsert(rows(spark, "b"), "other")
    with pytest.raises(ValueError, match="was built with"):
        ix.read("other")


def test_empty_and_null_ids(spark, tmp_path):
    ix = PublishedIndex(spark, str(tmp_path / "ix"), n_buckets=2)
    ix.upsert(rows(spark, "a").limit(0))
    assert ix.read().count() == 0 and ix.read().columns == ["id", "text", "vector", "metadata"]
    ix.upsert(rows(spark, "a").withColumn("id", F.lit(None).cast("string")).unionByName(rows(spark, "b")))
    assert [r.id for r in ix.read().collect()] == ["b"]


def test_search_over_the_published_rows(spark, tmp_path):
    ix = PublishedIndex(spark, str(tmp_path / "ix"), n_buckets=4)
    ix.upsert(rows(spark, "a", "bb", "ccc").unionByName(rows(spark, "d", lang="de")))
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, vector array<double>")
    hits = search(asked, ix.read(), 2, filters={"lang": "en", "n": 1}, text_key="body").collect()
    assert {h.body for h in hits} <= {"ta", "tbb", "tccc"} and len(hits) == 2
    assert next(h.id for h in hits if h["rank"] == 1) == "a"
