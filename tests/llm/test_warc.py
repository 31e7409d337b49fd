"""The WARC writer and reader: contract rows, files, repeatability, edge cases."""
import gzip
import hashlib
import io
import json
import os
import random

import pytest

from tessera.llm import warc
from tests.conftest import SMALL

SCHEMA = "page_id long, url string, html string, digest string, n int, shard string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 7, "clash") for i, u, h in rows], SCHEMA)


def made_rows():
    rng = random.Random(2)
    big = ["".join(rng.choice("abcdé <>\r\n") for _ in range(n)) for n in (999, 1000, 1500, 40_000)]
    rows = [(i, f"http://h/{i}", rng.choice([*big, None, "", "tiny", "x" * 999, "x" * 1000, "y" * rng.randint(1, 3000)]))
            for i in range(120)]
    rows += [((1 << 60) + 1, "http://last", big[2]), ((1 << 60), "http://before", big[2]), (-5, "http://a b\nc/ü", big[1])]
    return rows


def brute(rows):
    out, best = [], {}
    for i, _, h in rows:
        data = (h or "").encode()
        key = i if i is not None else -(1 << 70)
        if len(data) >= 1000:
            best[data] = max(best.get(data, key), key)
    done = set()
    for i, _, h in rows:
        data = (h or "").encode()
        key, kind, to = i if i is not None else -(1 << 70), "response", None
        if len(data) >= 1000:
            if key == best[data] and data not in done:
                done.add(data)
            else:
                kind, to = "revisit", best[data] if best[data] > -(1 << 70) else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), kind, to))
    return sorted(out, key=repr)


def contract(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()),
                  key=repr)


def files(path):
    return {f: open(os.path.join(path, f), "rb").read() for f in sorted(os.listdir(path))}


def test_rows_payloads_and_references(spark, tmp_path):
    rows, path = made_rows(), str(tmp_path / "a")
    warc.write(pages(spark, rows), path, shard_bytes=20_000, roll_bytes=3_000)
    found = warc.read(spark, path).collect()
    assert contract(warc.read(spark, path, payload=False)) == brute(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    by_record = {r.record_id: r for r in found}
    assert len(by_record) == len(found)
    for r in found:
        if r.record_type == "response":
            assert bytes(r.payload) == texts[r.page_id]
        else:
            target = by_record[r.refers_to_id]
            assert (target.record_type, target.page_id, target.payload_digest) == ("response", r.refers_to,
                                                                                   r.payload_digest)
    # Order of (page id) over the files in name order, each file from the front.
    order = [r.page_id for r in sorted(found, key=lambda r: (r.file, r.offset))]
    assert order == sorted(order)


def test_files_roll_and_hold_whole_records(spark, tmp_path):
    rows, path = made_rows(), str(tmp_path / "a")
    warc.write(pages(spark, rows), path, shard_bytes=20_000, roll_bytes=3_000)
    got = files(path)
    manifest = [json.loads(x) for x in got.pop("manifest.jsonl").decode().splitlines()]
    assert [m["name"] for m in manifest] == sorted(got)
    shards = {n.split("-")[1] for n in got}
    assert len(shards) > 3 and any(n.split("-")[2] != "000000.warc.gz" for n in got)
    for m in manifest:
        data = got[m["name"]]
        assert (len(data), hashlib.sha1(data).hexdigest()) == (m["bytes"], m["sha1"])
        text = gzip.decompress(data)  # any gzip reader reads all members
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC-Target-URI") == m["records"]
    assert sum(m["records"] for m in manifest) == len(rows)


def test_files_do_not_depend_on_partitions(spark, tmp_path):
    rows, a, b = made_rows(), str(tmp_path / "a"), str(tmp_path / "b")
    warc.write(pages(spark, rows).repartition(3), a, shard_bytes=20_000, roll_bytes=3_000)
    random.Random(1).shuffle(rows)
    warc.write(pages(spark, rows).repartition(17), b, shard_bytes=20_000, roll_bytes=3_000)
    assert files(a) == files(b)


def test_repeated_rows_null_ids_and_urls(spark, tmp_path):
    same = "z" * 2000
    rows = [(None, None, same)] * 300 + [(4, "u", "q" * 1200)] * 5 + [(9, None, "short")] * 3 + [(None, "v", None)] * 2
    rows += [(6, "u", "q" * 1200), (None, "w", "q" * 1200)]
    path = str(tmp_path / "a")
    warc.write(pages(spark, rows).repartition(5), path, shard_bytes=4_000, roll_bytes=2_000)
    found = warc.read(spark, path)
    assert contract(found) == brute(rows)
    assert len({r.record_id for r in found.collect()}) == len(rows)
    assert len({r.file.split("-")[1] for r in found.collect()}) > 10  # the repeated page is dealt over shards


def test_very_long_page_and_empty_table(spark, tmp_path):
    rows = [(1, "u", "long " * 2_000_000), (2, "u", "long " * 2_000_000), (3, "v", "b")]
    warc.write(pages(spark, rows), str(tmp_path / "a"))
    assert contract(warc.read(spark, str(tmp_path / "a"), payload=False)) == brute(rows)
    warc.write(pages(spark, []), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).collect() == []
    assert len(files(str(tmp_path / "b"))) == 2


def test_incomplete_and_changed_archives_are_refused(spark, tmp_path):
    rows, path = made_rows(), str(tmp_path / "a")
    warc.write(pages(spark, rows), path, shard_bytes=20_000)
    assert not [f for f in os.listdir(path) if f.startswith("_temporary")]
    before = files(path)
    with pytest.raises(Exception, match="holds an archive"):
        warc.write(pages(spark, rows[:3]), path)
    assert files(path) == before and not [f for f in os.listdir(path) if f.startswith("_temporary")]
    warc.write(pages(spark, rows[:3]), path, overwrite=True)
    assert contract(warc.read(spark, path)) == brute(rows[:3])
    name = next(f for f in files(path) if f.endswith(".gz"))
    data = files(path)[name]
    with open(os.path.join(path, name), "wb") as f:
        f.write(data + warc._info("more"))
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read(spark, path).collect()
    os.remove(os.path.join(path, "manifest.jsonl"))
    with pytest.raises(Exception, match="no complete archive"):
        warc.read(spark, path).collect()


def test_repeated_tasks_leave_one_set_of_files(tmp_path):
    """A task that ran twice hands in one list; the other's files go."""
    class Row:
        shard, page_id, digest, url, refers_to, refers_url = 0, 1, hashlib.sha1(b"x").digest(), "u", None, None
        is_revisit, single, n_bytes, payload = False, False, 1, b"x"

    writer = warc._Writer(str(tmp_path / "a"), 1000, False)
    lost, kept = writer.write(iter([Row])), writer.write(iter([Row]))
    assert lost.files[0]["temporary"] != kept.files[0]["temporary"]
    assert os.listdir(tmp_path / "a") == [f"_temporary-{writer.job}"]
    writer.commit([kept])
    assert sorted(os.listdir(tmp_path / "a")) == ["manifest.jsonl", "pages-000000-000000.warc.gz"]


def test_broken_records_are_told():
    good = warc._info("x")
    list(warc.records_of(io.BytesIO(good)))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_of(io.BytesIO(good[:-9])))


def test_pages_of_the_tables(spark, tmp_path):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    warc.write(df, str(tmp_path / "a"))
    assert contract(warc.read(spark, str(tmp_path / "a"))) == brute([(r.page_id, r.url, r.html) for r in df.collect()])
