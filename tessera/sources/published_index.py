"""A vector index that is changed bucket by bucket and published at once.

Rows lie in hash buckets of their id. An upsert reads and rewrites only the
buckets that the new rows touch, into fresh folders; nothing that a reader may
be reading is changed. Then a manifest, which names the folder of every
bucket, the embedding model and the source version, is written under a
temporary name and renamed to the next number. Readers take the manifest of
the largest number, so they see all of an upsert or nothing; a second writer
that claims the same number fails. A lost executor or a failed job leaves at
most folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import DROP_SHUFFLES, settings
from tessera.sources.index_store import DEFAULT_MODEL, upsert_index

ROWS_AT_ONCE = 1 << 19  # old and new rows that are shuffled together


class PublishedIndex:
    """Index rows ``(id string, ...)`` under ``path``, with any other columns.

    ``n_buckets`` counts for a new index only; choose it so that a bucket is a
    few hundred megabytes. The manifest has one short entry a bucket."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 64):
        self.spark, self.path, self.n_buckets = spark, path.rstrip("/"), n_buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, "manifests", *parts)))

    def manifest(self) -> dict | None:
        """The newest published manifest, or None before the first one."""
        fs = self._at().getFileSystem(self._conf)
        if not fs.exists(self._at()):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(self._at())]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return None
        stream = fs.open(self._at(f"{max(numbers):08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs = self._at().getFileSystem(self._conf)
        draft, final = self._at(f"_draft-{uuid.uuid4().hex}"), self._at(f"{manifest['number']:08d}.json")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(
            getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(draft, final, no_options)   # fails if the number is taken

    def read(self, model: str | None = None) -> DataFrame:
        """The published rows. Without any, an error says to build the index
        (A11); ``model`` must be the one that built it (F8)."""
        now = self.manifest()
        if now is None:
            raise FileNotFoundError(f"no index at {self.path}; build it with PublishedIndex.upsert")
        if model is not None and model != now["embedding_model"]:
            raise ValueError(f"index {self.path} was built with {now['embedding_model']!r}, not {model!r}")
        return self._rows(now, now["buckets"])

    def _rows(self, manifest: dict, buckets) -> DataFrame:
        paths = sorted(f"{self.path}/{manifest['buckets'][b]}" for b in buckets)
        reader = self.spark.read.schema(manifest["schema"])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], manifest["schema"])

    def upsert(self, rows: DataFrame, model: str | None = None, version: str | None = None) -> dict:
        """Add rows or replace those with their id (null ids go), publish, and
        return the manifest. Vectors of another model are refused."""
        old = self.manifest()
        if old and model is not None and model != old["embedding_model"]:
            raise ValueError(f"index {self.path} was built with {old['embedding_model']!r}, not {model!r}")
        model = model or (old["embedding_model"] if old else DEFAULT_MODEL)
        n = old["n_buckets"] if old else self.n_buckets
        names = rows.columns
        rows = rows.withColumn("id", F.col("id").cast("string")).where("id is not null").select(*names)
        schema = old["schema"] if old else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        bucket = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        def counts(df):   # n_buckets at most
            return {str(r["b"]): r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()}
        fresh = counts(rows)
        touched = list(fresh)
        there = counts(self._rows(old, [b for b in touched if b in old["buckets"]])) if old else {}
        groups, held = [], 0
        for b in touched:
            more = fresh[b] + there.get(b, 0)
            if not groups or held + more > ROWS_AT_ONCE:
                groups, held = [*groups, []], 0
            groups[-1].append(b)
            held += more
        folder = f"data/{uuid.uuid4().hex}"
        for group in groups:   # what is shuffled for some buckets goes before the next ones
            new_rows = rows.where(bucket.isin([int(b) for b in group]))
            kept = self._rows(old, [b for b in group if b in old["buckets"]]) if old else rows.limit(0)
            with settings(self.spark, {DROP_SHUFFLES: "true"}):
                (upsert_index(kept.select(*names), new_rows).withColumn("bucket", bucket)
                 .repartition(len(group), "bucket").write.mode("append").partitionBy("bucket")
                 .parquet(f"{self.path}/{folder}"))
        buckets = {**(old["buckets"] if old else {}), **{b: f"{folder}/bucket={b}" for b in touched}}
        new = {"number": (old["number"] if old else 0) + 1, "embedding_model": model, "n_buckets": n, "schema": schema,
               "source_version": version if version is not None else (old or {}).get("source_version"),
               "buckets": buckets}
        self._publish(new)
        return new
