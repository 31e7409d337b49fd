"""Web archives: a deterministic sharded WARC writer and its reader.

``write`` turns pages into WARC 1.1 records, each a gzip member of its own:

1. Pages are numbered and written once with the digest and length of their
   payload, so that all later steps see the same rows.
2. Of payloads that are equal and at least ``min_revisit`` bytes long, the page
   with the greatest (page_id, hash of url, number) is the response; the others
   become revisit records without a payload.
3. Records are ordered by (page_id, payload digest, hash of url, number). Their
   running size over the whole order, from a range sort of the slim columns and
   the sums of its partitions, cuts the order into shards of about
   ``shard_bytes``. The cuts depend on the rows alone, not on their partitions.
4. Pages are sent to their shard once, each behind the row that says whether it
   is a revisit, and sorted there. A task writes its shards one record at a
   time and begins a new file when the compressed size reaches ``roll_bytes``.
   Headers, HTTP heads, record ids and digests are made anew from the payload.

Files are written under names of the task's own and take their final names when
the whole job is done, from the list that the successful tasks handed back;
what failed or repeated tasks wrote is dropped with the folder. The manifest is
written last, under another name first: an archive without one is not complete,
and readers refuse it. Equal input gives equal files and names.

The reader streams files member by member and checks every record: block and
payload digests, lengths, and the file's size and digest in the manifest.

The folder is reached by pyarrow's file systems: a mount that all executors
share, or a store that pyarrow knows (HDFS needs libhdfs on the executors).

Edge cases. A null payload is empty; a null url is written as urn:page and the
id, and characters of a url outside printable ASCII are percent-encoded. Pages
without an id come first and are read back with a null id. Rows may repeat:
equal rows are records of their own, in order of their numbers. A payload is
held by a task once; a shard's memory is that of its longest record. Without
pages there is one file with only a warcinfo record. Only the named columns are
read; others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.session import materialize, scratch_path

SHARD_BYTES = 32 << 20   # payload of a shard, at least
MAX_SHARDS = 1 << 16     # the cuts of so many shards (3 MB) go with the tasks
ROLL_BYTES = 8 << 20     # compressed size at which a file ends
MIN_REVISIT = 1000
RECORD_BYTES = 512       # headers, in the running size
DATE = "1970-01-01T00:00:00Z"  # pages have no date of their own
READ_BYTES = 1 << 20
MANIFEST = "manifest.jsonl"
# Fixed values of WARC 1.1.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INFO_FORMAT = "WARC File Format 1.1"

RECORDS = ("file string, offset long, record_id string, record_type string, page_id long, target_uri string, "
           "payload_bytes long, payload_digest string, refers_to_id string, refers_to long, payload binary")
STORED = ("shard int, page_id long, digest binary, url string, refers_to long, refers_url string, is_revisit boolean, "
          "single boolean, n_bytes long, payload binary")


def file_system(uri: str):
    """(file system, path) of a folder: a local or mounted path, or a URI."""
    from pyarrow import fs
    local = re.sub(r"^file:/+", "/", uri)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(uri)


# --- records ---------------------------------------------------------------

def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _uri(url: str | None, page_id) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member with no time stamp."""
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None),
                         f"Content-Length: {len(block)}".encode(), b"", b""])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _info(name: str) -> bytes:
    block = f"software: tessera\r\nformat: {INFO_FORMAT}\r\n".encode()
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("info", name)), ("WARC-Date", DATE),
                    ("WARC-Filename", name), ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())),
                    ("Content-Type", "application/warc-fields")], block)


def _record(row, ordinal: int) -> bytes:
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.n_bytes}"
            "\r\n\r\n").encode()
    block = head if row.is_revisit else head + bytes(row.payload)
    digest = bytes(row.digest)
    # The one response of a payload that may be referred to is named by the payload alone.
    name = _urn("payload", digest.hex()) if row.single else _urn("record", digest.hex(), row.page_id, row.shard, ordinal)
    fields = [("WARC-Type", "revisit" if row.is_revisit else "response"), ("WARC-Record-ID", name),
              ("WARC-Date", DATE), ("WARC-Target-URI", _uri(row.url, row.page_id)),
              ("WARC-Payload-Digest", _base32(digest)),
              ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())), ("X-Page-Id", row.page_id)]
    if row.is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn("payload", digest.hex())),
                   ("WARC-Refers-To-Target-URI", _uri(row.refers_url, row.refers_to)),
                   ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", row.refers_to)]
    return _member([*fields, ("Content-Type", "application/http; msgtype=response")], block)


def records_of(stream) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, header fields, block) of the records of an archive file."""
    at, data = 0, b""
    while True:
        z, out, used = zlib.decompressobj(31), io.BytesIO(), 0
        while not z.eof:
            data = data or stream.read(READ_BYTES)
            if not data:
                if used:
                    raise ValueError(f"record at {at} is cut off")
                return
            out.write(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data
        raw = out.getvalue()
        end = raw.index(b"\r\n\r\n")
        lines = raw[:end].split(b"\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.decode().split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        if raw[end + 4 + size:] != b"\r\n\r\n":
            raise ValueError(f"record at {at} has another length than it says")
        block = raw[end + 4:end + 4 + size]
        if fields.get("WARC-Block-Digest") != _base32(hashlib.sha1(block).digest()):
            raise ValueError(f"record at {at} does not have its block digest")
        yield at, fields, block
        at += used


# --- the Spark source ------------------------------------------------------

@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    def __init__(self, path: str, roll_bytes: int, overwrite: bool):
        self.path, self.roll, self.overwrite = path, roll_bytes, overwrite
        self.job = uuid.uuid4().hex

    def _folder(self) -> str:
        return f"{self.path.rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator) -> WriterCommitMessage:
        fs, folder = file_system(self._folder())
        fs.create_dir(folder, recursive=True)
        mine, files = uuid.uuid4().hex, []
        out = shard = None

        def close():
            if out is not None:
                out["stream"].close()
                files.append({k: out[k] for k in ("temporary", "name", "records", "bytes", "sha1")}
                             | {"sha1": out["sha1"].hexdigest()})

        def put(member: bytes):
            out["stream"].write(member)
            out["sha1"].update(member)
            out["bytes"] += len(member)

        ordinal = number = 0
        for row in iterator:
            if row.shard != shard:
                close()
                out, shard, ordinal, number = None, row.shard, 0, 0
            if out is not None and out["bytes"] >= self.roll:
                close()
                out, number = None, number + 1
            if out is None:
                name = f"pages-{shard:06d}-{number:06d}.warc.gz"
                temporary = f"{folder}/{name}.{mine}"
                out = {"stream": fs.open_output_stream(temporary, compression=None), "temporary": temporary,
                       "name": name, "records": 0, "bytes": 0, "sha1": hashlib.sha1()}
                put(_info(name))
            if row.digest is not None:  # null: an archive without pages
                put(_record(row, ordinal))
                out["records"] += 1
                ordinal += 1
        close()
        return _Written(files)

    def commit(self, messages) -> None:
        fs, folder = file_system(self.path)
        manifest = f"{folder}/{MANIFEST}"
        fs.create_dir(folder, recursive=True)
        from pyarrow.fs import FileType
        if fs.get_file_info(manifest).type != FileType.NotFound:
            if not self.overwrite:
                raise FileExistsError(f"{self.path} holds an archive")
            old = _manifest(self.path)
            fs.delete_file(manifest)  # from here on there is no complete archive, until the new manifest
            for f in old:
                fs.delete_file(f"{folder}/{f['name']}")
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        for f in files:
            fs.move(f["temporary"], f"{folder}/{f['name']}")
        temporary = f"{manifest}.{self.job}"
        with fs.open_output_stream(temporary, compression=None) as out:
            for f in files:
                out.write((json.dumps({k: f[k] for k in ("name", "records", "bytes", "sha1")}) + "\n").encode())
        fs.move(temporary, manifest)
        self._drop()

    def abort(self, messages) -> None:
        self._drop()

    def _drop(self) -> None:
        fs, folder = file_system(self._folder())
        from pyarrow.fs import FileType
        if fs.get_file_info(folder).type != FileType.NotFound:
            fs.delete_dir(folder)


def _manifest(path: str) -> list[dict]:
    fs, folder = file_system(path)
    try:
        with fs.open_input_stream(f"{folder}/{MANIFEST}", compression=None) as f:
            return [json.loads(x) for x in f.read().decode().splitlines()]
    except FileNotFoundError:
        raise FileNotFoundError(f"{path} holds no complete archive") from None


class _Checked:
    """A stream that keeps the size and digest of what it has handed out."""

    def __init__(self, stream):
        self.stream, self.size, self.sha1 = stream, 0, hashlib.sha1()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sha1.update(data)
        return data


class _Reader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload = path, with_payload

    def partitions(self):
        return [InputPartition(f) for f in _manifest(self.path)] or [InputPartition(None)]

    def read(self, partition):
        f = partition.value
        if f is None:
            return
        fs, folder = file_system(self.path)
        with fs.open_input_stream(f"{folder}/{f['name']}", compression=None) as raw:
            stream, n = _Checked(raw), 0
            for at, fields, block in records_of(stream):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                n += 1
                yield self._row(f["name"], at, fields, block)
            if (n, stream.size, stream.sha1.hexdigest()) != (f["records"], f["bytes"], f["sha1"]):
                raise ValueError(f"{f['name']} is not the file of the manifest")

    def _row(self, name: str, at: int, fields: dict, block: bytes) -> tuple:
        end = block.index(b"\r\n\r\n") + 4
        head = dict(x.split(": ", 1) for x in block[:end - 4].decode().split("\r\n")[1:])
        size, payload = int(head["Content-Length"]), block[end:]
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
        kind = fields["WARC-Type"]
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
            raise ValueError(f"{name}: the payload at {at} is not what its headers say")
        number = {k: int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
        return (name, at, fields["WARC-Record-ID"], kind, number["X-Page-Id"], fields["WARC-Target-URI"], size,
                digest.hex(), fields.get("WARC-Refers-To"), number["X-Refers-To-Page-Id"],
                payload if self.with_payload and kind == "response" else None)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option payload = false
    leaves payloads out. Written through ``write``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options["roll_bytes"]), overwrite)


# --- the jobs --------------------------------------------------------------

KEYS = ("page_id", "digest", "u", "n")


def stage(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Numbered pages with the digest and length of their payload."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string")
                        .alias("url"), payload.alias("payload"))
    return rows.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.xxhash64("url").alias("u"),
                       F.monotonically_increasing_id().alias("n"), F.octet_length("payload").cast("long")
                       .alias("n_bytes"), "url", "payload")


def roles(staged: DataFrame, min_revisit: int) -> DataFrame:
    """(keys, url, n_bytes, refers_to, refers_url, is_revisit) of every page."""
    slim = staged.select(*KEYS, "url", "n_bytes")
    place = F.struct("page_id", "u", "n", "url")
    shared = (slim.where(F.col("n_bytes") >= min_revisit).groupBy("digest")
              .agg(F.max(place).alias("top"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    # Digest and length name a payload; a length below the bound never meets.
    joined = slim.join(shared, "digest", "left")
    revisit = F.col("top").isNotNull() & (F.col("n_bytes") >= min_revisit) & (F.col("n") != F.col("top.n"))
    return joined.select(*KEYS, "url", "n_bytes", F.when(revisit, F.col("top.page_id")).alias("refers_to"),
                         F.when(revisit, F.col("top.url")).alias("refers_url"), revisit.alias("is_revisit"))


def cuts(plan: DataFrame, shard_bytes: int) -> list:
    """The least key of every shard, in order. ``plan``: roles."""
    size = F.when(F.col("is_revisit"), 0).otherwise(F.col("n_bytes")) + RECORD_BYTES
    slim = plan.select(*KEYS, size.alias("size"))
    # Partitions of the range sort are numbered in order; their numbers are stored with the rows.
    ranged = materialize(slim.repartitionByRange(*KEYS).withColumn("part", F.spark_partition_id()), "warc-order")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("size"))
    before = sums.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    total = sums.agg(F.sum("size")).first()[0] or 0
    limit = max(shard_bytes, -(-total // MAX_SHARDS))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy(*KEYS)) - F.col("size")
    first = (ranged.withColumn("inside", inside).join(before, "part")
             .groupBy(F.floor((F.col("before") + F.col("inside")) / limit).alias("shard"))
             .agg(F.min(F.struct(*KEYS)).alias("k")))
    return [tuple(r["k"]) for r in first.orderBy("shard").collect()]


def _order_keys(page_id: pd.Series, digest: pd.Series, u: pd.Series, n: pd.Series) -> np.ndarray:
    """The key as bytes that sort as the columns do (null ids first)."""
    def wide(x):
        signed = x.astype(np.int64) if isinstance(x, np.ndarray) else x.to_numpy(dtype=np.int64)
        return (signed.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)

    known = page_id.notna().to_numpy()
    ids = np.array([0 if x is pd.NA or x is None or x != x else int(x) for x in page_id.tolist()], dtype=np.int64)
    parts = [known.astype(np.uint8)[:, None], wide(ids),
             np.frombuffer(b"".join(digest), dtype=np.uint8).reshape(-1, 20), wide(u), wide(n),
             np.ones((len(known), 1), dtype=np.uint8)]  # numpy strips zeros at the end
    return np.ascontiguousarray(np.concatenate(parts, axis=1)).view("S46").ravel()


def _shard_of(bounds: list) -> Column:
    """Number of the shard that a key lies in."""
    low = _order_keys(*(pd.Series([b[i] for b in bounds], dtype=object if i < 2 else np.int64) for i in range(4)))

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, digest: pd.Series, u: pd.Series, n: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype="int32")
        return pd.Series((np.searchsorted(low, _order_keys(page_id, digest, u, n), side="right") - 1).astype(np.int32))

    # Ids as text: a nullable long would come as a float and lose digits.
    return shard(F.col("page_id").cast("string"), F.col("digest"), F.col("u"), F.col("n"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT,
          overwrite: bool = False) -> None:
    """Write ``pages`` as an archive folder."""
    spark = pages.sparkSession
    held = scratch_path(spark, "warc-pages")
    stage(pages, id_col, url_col, payload_col).write.option("compression", "zstd").parquet(held)
    staged = spark.read.parquet(held)
    plan = materialize(roles(staged, min_revisit), "warc-roles")
    bounds = cuts(plan, shard_bytes)
    register(spark)
    if bounds:
        shard = _shard_of(bounds)
        said = plan.where("is_revisit").select(shard.alias("shard"), *KEYS, F.lit(0).alias("side"), "refers_to",
                                               "refers_url", F.lit(None).cast("string").alias("url"),
                                               F.lit(None).cast("long").alias("n_bytes"),
                                               F.lit(None).cast("binary").alias("payload"))
        full = staged.select(shard.alias("shard"), *KEYS, F.lit(1).alias("side"),
                             F.lit(None).cast("long").alias("refers_to"),
                             F.lit(None).cast("string").alias("refers_url"), "url", "n_bytes", "payload")
        rows = (full.unionByName(said).repartitionById(len(bounds), F.col("shard"))
                .sortWithinPartitions("shard", *KEYS, "side").mapInArrow(_judge(min_revisit), STORED))
    else:
        rows = spark.createDataFrame([(0, *[None] * 9)], STORED)
    (rows.write.format("warc").mode("overwrite" if overwrite else "append").option("roll_bytes", str(roll_bytes))
     .save(path))


def _judge(min_revisit: int):
    """Join each page with the row before it that calls it a revisit."""
    def run(batches):
        import pyarrow as pa
        said = None  # (number, refers_to, refers_url)
        for b in batches:
            n, side = b.column("n").to_pylist(), b.column("side").to_pylist()
            to, to_url = b.column("refers_to").to_pylist(), b.column("refers_url").to_pylist()
            keep, found = [], []
            for i, number in enumerate(n):
                if side[i] == 0:
                    said = (number, to[i], to_url[i])
                    continue
                keep.append(i)
                found.append(said if said is not None and said[0] == number else None)
            part = b.take(pa.array(keep, pa.int64()))
            revisit = pa.array([f is not None for f in found], pa.bool_())
            single = pa.array([f is None and size >= min_revisit
                               for f, size in zip(found, part.column("n_bytes").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [part.column("shard"), part.column("page_id"), part.column("digest"), part.column("url"),
                 pa.array([f and f[1] for f in found], pa.int64()), pa.array([f and f[2] for f in found], pa.string()),
                 revisit, single, part.column("n_bytes"), part.column("payload")],
                names=[x.split()[0] for x in STORED.split(", ")])
    return run


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive folder, responses and revisits, checked."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
