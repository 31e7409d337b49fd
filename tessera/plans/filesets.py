"""Queries that read folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.file_sets import DocSet, write_code_examples, write_doc_chunks
from tessera.plans import sqltext as S
from tessera.plans.corpus import DOC_DATASETS, SECTIONS_SQL, fx1_markdown
from tessera.plans.registry import register
from tessera.session import scratch_path
from tessera.sources.files import read_partitioned
from tessera.sources.tables import read_table


def _put_files(files: DataFrame, root: str) -> None:
    """Rows (path, content binary) as files under a shared folder; a repeated
    task writes the same files again."""
    def put(rows):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
        made = set()
        for r in rows:
            folder = f"{base}/{r['path']}".rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(f"{base}/{r['path']}") as out:
                out.write(bytes(r["content"]))
    files.foreachPartition(put)


# FX1 as files: the folder of a version by conv_id % 3; every eleventh ends in
# a byte that is not UTF-8, every fifth also lies there as .mdx.
def _doc_files(spark, sf_dir):
    docs = fx1_markdown(spark, sf_dir)
    k = F.col("conv_id")
    bad = F.when(k % 11 == 5, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    folder = F.concat(F.lit("v"), (k % len(DOC_DATASETS)).cast("string"), F.lit("/"))
    md = docs.select(F.concat(folder, "source_file").alias("path"),
                     F.concat(F.encode("content", "UTF-8"), bad).alias("content"), k)
    mdx = md.where(k % 5 == 0).withColumn("path", F.concat("path", F.lit("x")))
    root = scratch_path(spark, "doc-files")
    _put_files(md.unionByName(mdx).select("path", "content"), root)
    return [DocSet(v, f"{root}/v{i}", url) for i, (v, url) in enumerate(DOC_DATASETS)]


_SETS = ", ".join(f"({i}, '{v}', '{u}')" for i, (v, u) in enumerate(DOC_DATASETS))


@register("doc_file_chunks", sql=f"""WITH {SECTIONS_SQL},
sets AS (SELECT * FROM (VALUES {_SETS}) t(i, doc_version, base_url)),
c AS (SELECT s.conv_id, s.header, {S.sanitize_links('s.text')} AS text_chunk, d.source_file
      FROM sections s JOIN docs d USING (conv_id) WHERE conv_id % 11 <> 5),
w AS (SELECT *, {S.word_count('text_chunk')} AS word_length FROM c)
SELECT doc_version, text_chunk, coalesce(header, 'N/A') AS header,
       base_url || regexp_replace(source_file, '\\.md$', '') AS url, source_file,
       CAST(word_length AS INTEGER) AS word_length, md5(text_chunk) AS id
FROM w JOIN sets ON sets.i = w.conv_id % {len(DOC_DATASETS)} WHERE word_length >= 10""")
def doc_file_chunks(spark, sf_dir):
    """Folders of Markdown files, one a documentation version, to one chunk set
    with a folder a version; the last version is then written a second time,
    which leaves the others in place (A1, A3, A5, A10, D3)."""
    sets = _doc_files(spark, sf_dir)
    path = scratch_path(spark, "doc-chunks")
    write_doc_chunks(spark, sets, path)
    write_doc_chunks(spark, sets[-1:], path)
    return read_partitioned(spark, path, "doc_version").select(
        "doc_version", "text_chunk", "header", "url", "source_file", "word_length", "id")


@register("doc_file_rejects", sql=f"""SELECT doc_version, 'c' || (conv_id % 10) || '/' || conv_id || '.md' AS source_file,
       'not valid UTF-8' AS reason
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 11 = 5)
JOIN (VALUES {_SETS}) t(i, doc_version, base_url) ON i = conv_id % {len(DOC_DATASETS)}""")
def doc_file_rejects(spark, sf_dir):
    """The files of that run that are not valid UTF-8 (A3)."""
    sets = _doc_files(spark, sf_dir)
    rejects = write_doc_chunks(spark, sets, scratch_path(spark, "doc-chunks"))
    return rejects.select("doc_version", F.regexp_extract("path", "/v\\d+/(c\\d+/.*)$", 1).alias("source_file"), "reason")


_CODE = """'Supplier(name=''' || s_name || ''', description=''of nation ' || s_nationkey || ''')' || chr(10)
       || CASE WHEN s_suppkey % 3 = 0 THEN 'Nation(n_' || s_nationkey || ', description="key ' || s_nationkey || '")' || chr(10)
          ELSE '' END"""


@register("example_files", sql=f"""WITH f AS (
  SELECT {_CODE} AS code, s_name, s_nationkey, s_suppkey,
         CASE WHEN s_suppkey % 2 = 0 THEN 'samples' ELSE 'tutorials' END AS directory_type
  FROM supplier WHERE s_suppkey % 13 <> 0)
SELECT 'Example of Supplier. of nation ' || s_nationkey AS text, code, directory_type FROM f
UNION ALL
SELECT 'Example of Nation. key ' || s_nationkey, code, directory_type FROM f WHERE s_suppkey % 3 = 0""")
def example_files(spark, sf_dir):
    """Code files of two folders (a third does not exist and is skipped) to
    labelled examples, a folder a kind, read back as one set with repeats; files
    of under 50 characters hold none (A2, A6, B1, B5, I4)."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    k, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    call = F.concat(F.lit("Supplier(name='"), "s_name", F.lit("', description='of nation "), nation, F.lit("')\n"))
    second = F.when(k % 3 == 0, F.concat(F.lit("Nation(n_"), nation, F.lit(', description="key '), nation, F.lit('")\n')))
    code = F.when(k % 13 == 0, F.lit("x = 1\n")).otherwise(F.concat(call, F.coalesce(second, F.lit(""))))
    path = F.concat(F.when(k % 2 == 0, F.lit("samples/")).otherwise(F.lit("tutorials/")), (k % 10).cast("string"),
                    F.lit("/s"), k.cast("string"), F.lit(".py"))
    root = scratch_path(spark, "code-files")
    _put_files(s.select(path.alias("path"), F.encode(code, "UTF-8").alias("content")), root)
    out = scratch_path(spark, "examples")
    write_code_examples(spark, [(f"{root}/{kind}", kind) for kind in ("samples", "tutorials", "absent")], out)
    return read_partitioned(spark, out, "directory_type").select("text", "code", "directory_type")
