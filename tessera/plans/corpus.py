"""Corpus preparation queries: sectioning, cleaning, URLs, version routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import doc_url, route_doc_version, version_major_minor, with_sanitized_links
from tessera.operators.sections import chunk_sections, markdown_sections
from tessera.plans import sqltext as S
from tessera.plans.registry import register
from tessera.sources.tables import read_table

DOCS_BASE_URL = "https://docs.example.com/docs/"

# ---------------------------------------------------------------- fixtures
# FX1: conversations as markdown files, one per conversation: "# role" then
# the text; system turns become a fenced block holding a false header.


def fx1_markdown(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    txt = F.coalesce(F.col("text"), F.lit(""))
    piece = (F.when(F.col("role") == "system",
                    F.concat(F.lit("```\n# system\n"), txt, F.lit("\n```")))
             .otherwise(F.concat(F.lit("# "), F.col("role"), F.lit("\n"), txt)))
    docs = conv.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece")))),
        lambda x: x["piece"]), "\n").alias("content"))
    path = F.concat(F.lit("c"), (F.col("conv_id") % 10).cast("string"), F.lit("/"),
                    F.col("conv_id").cast("string"), F.lit(".md"))
    return docs.withColumn("source_file", path)


FX1_SQL = """docs AS (
  SELECT conv_id,
         string_agg(CASE WHEN role = 'system'
                         THEN '```' || chr(10) || '# system' || chr(10) || coalesce(text, '') || chr(10) || '```'
                         ELSE '# ' || role || chr(10) || coalesce(text, '') END,
                    chr(10) ORDER BY turn) AS content,
         'c' || CAST(conv_id % 10 AS VARCHAR) || '/' || CAST(conv_id AS VARCHAR) || '.md' AS source_file
  FROM conversations GROUP BY conv_id)"""

SECTIONS_SQL = f"""{FX1_SQL},
sp AS (SELECT conv_id, {S.split_lines('content')} AS arr FROM docs),
ln AS (SELECT conv_id, unnest(arr) AS line, generate_subscripts(arr, 1) AS pos FROM sp),
f1 AS (SELECT *, {S.lstrip_ws('line')} AS s FROM ln),
f2 AS (SELECT *, starts_with(s, '```') AS is_fence, (s = '#' OR starts_with(s, '# ')) AS hs FROM f1),
f3 AS (SELECT *, coalesce(sum(CASE WHEN is_fence THEN 1 ELSE 0 END) OVER (
          PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fb
       FROM f2),
f4 AS (SELECT *, (NOT is_fence AND fb % 2 = 0 AND hs) AS is_header FROM f3),
f5 AS (SELECT *, sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (
          PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no
       FROM f4),
g AS (SELECT conv_id, CAST(section_no AS BIGINT) AS section_no,
             max(CASE WHEN is_header THEN line END) AS header_raw,
             string_agg(line, chr(10) ORDER BY pos) AS raw
      FROM f5 GROUP BY conv_id, section_no),
sections AS (SELECT conv_id, section_no, {S.trim_ws('header_raw')} AS header, {S.trim_ws('raw')} AS text
             FROM g WHERE {S.trim_ws('raw')} <> '')"""


@register("md_sections", sql=f"WITH {SECTIONS_SQL} SELECT conv_id, section_no, header, text FROM sections")
def md_sections(spark, sf_dir):
    """Markdown files -> top-level sections with fence handling."""
    docs = fx1_markdown(spark, sf_dir)
    return markdown_sections(docs, "conv_id", "content").select("conv_id", "section_no", "header", "text")


@register("chunk_filter", sql=f"""WITH {SECTIONS_SQL},
c AS (SELECT s.conv_id, s.header, {S.sanitize_links('s.text')} AS text_chunk, d.source_file
      FROM sections s JOIN docs d USING (conv_id)),
w AS (SELECT *, {S.word_count('text_chunk')} AS word_length FROM c)
SELECT text_chunk, coalesce(header, 'N/A') AS header,
       '{DOCS_BASE_URL}' || regexp_replace(source_file, '\\.md$', '') AS url,
       source_file, CAST(word_length AS INTEGER) AS word_length, md5(text_chunk) AS id
FROM w WHERE word_length >= 10""")
def chunk_filter(spark, sf_dir):
    """Sections -> cleaned chunks of at least 10 words, with URL and md5 id
    (B2, C3, C6, C2, A8)."""
    docs = fx1_markdown(spark, sf_dir)
    secs = markdown_sections(docs, "conv_id", "content")
    chunks = chunk_sections(secs).join(docs.select("conv_id", "source_file"), "conv_id")
    return chunks.select("text_chunk", "header", doc_url("source_file", F.lit(DOCS_BASE_URL)).alias("url"),
                         "source_file", "word_length", F.md5("text_chunk").alias("id"))


# FX2: documents with link forms inserted before and after the text.
# The six link forms.
LINK_FORMS = [
    "[the guide](../guides/setup.md)",
    "[this section](#overview)",
    "[the site](https://example.com/docs/page.md)",
    "`reference/api.mdx`",
    "see intro.md",
    "[ ]",
]


def _form(idx_col):
    c = F.lit(LINK_FORMS[0])
    for i in range(1, len(LINK_FORMS)):
        c = F.when(idx_col == i, F.lit(LINK_FORMS[i])).otherwise(c)
    return c


def fx2_linked(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.concat(_form(F.col("doc_id") % 6), F.lit(" "), F.col("text"),
                                       F.lit(" "), _form((F.col("doc_id") + 1) % 6)).alias("text"))


def _form_sql(expr: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {S.q(f)}" for i, f in enumerate(LINK_FORMS))
    return f"(CASE {expr} {whens} END)"


@register("link_clean", sql=f"""WITH fx2 AS (
  SELECT doc_id, {_form_sql('doc_id % 6')} || ' ' || text || ' ' || {_form_sql('(doc_id + 1) % 6')} AS text
  FROM documents)
SELECT doc_id, {S.sanitize_links('text')} AS text_clean FROM fx2""")
def link_clean(spark, sf_dir):
    """Internal-link cleaning over whole documents."""
    return with_sanitized_links(fx2_linked(spark, sf_dir), "text", "text_clean").select("doc_id", "text_clean")


# FX3: documentation paths from part: name equals folder for even keys,
# one-part paths for every tenth key.
def fx3_paths(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    path = (F.when(F.col("p_partkey") % 10 == 0, F.concat(F.col("p_name"), F.lit(".md")))
            .when(F.col("p_partkey") % 2 == 0,
                  F.concat(F.lit("g/"), F.col("p_type"), F.lit("/"), F.col("p_type"), F.lit(".md")))
            .otherwise(F.concat(F.lit("g/"), F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit(".md"))))
    return p.select("p_partkey", path.alias("path"))


@register("doc_url", sql=f"""WITH fx3 AS (
  SELECT p_partkey,
         CASE WHEN p_partkey % 10 = 0 THEN p_name || '.md'
              WHEN p_partkey % 2 = 0 THEN 'g/' || p_type || '/' || p_type || '.md'
              ELSE 'g/' || p_type || '/' || p_name || '.md' END AS path
  FROM part),
r AS (SELECT p_partkey, path, regexp_replace(path, '\\.md$', '') AS rel FROM fx3),
s AS (SELECT *, string_split(rel, '/') AS parts FROM r)
SELECT p_partkey, path,
       '{DOCS_BASE_URL}' || regexp_replace(
           CASE WHEN len(parts) >= 2 AND parts[-1] = parts[-2]
                THEN array_to_string(parts[1:len(parts) - 1], '/') ELSE rel END, '^/+', '') AS url
FROM s""")
def doc_url_q(spark, sf_dir):
    """Documentation URL rule with folder de-duplication."""
    p = fx3_paths(spark, sf_dir)
    return p.select("p_partkey", "path", doc_url("path", F.lit(DOCS_BASE_URL)).alias("url"))


# FX4: a version string per document, with pre-release, garbage and null cases.
def fx4_versions(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "source")
    k = F.col("doc_id")
    s = lambda c: c.cast("string")
    v = (F.when(k % 8 == 0, F.lit(None).cast("string"))
         .when(k % 8 == 1, F.lit("garbage"))
         .when(k % 8 == 2, F.concat(F.lit("2."), s(k % 3), F.lit(".0")))
         .when(k % 8 == 3, F.concat(F.lit("1."), s(k % 4), F.lit(".0b"), s(k % 20)))
         .when(k % 8 == 4, F.lit("0.9"))
         .otherwise(F.concat(F.lit("1."), s(k % 4), F.lit("."), s(k % 10))))
    return d.select("doc_id", "source", v.alias("version"))


# One documentation dataset per routed version.
DOC_DATASETS = [("latest", "https://docs.example.com/docs/beta/"),
                ("1.1", "https://docs.example.com/docs/"),
                ("1.0", "https://docs.example.com/docs/1.0/")]


@register("version_route", sql=f"""WITH fx4 AS (
  SELECT doc_id, source,
         CASE WHEN doc_id % 8 = 0 THEN NULL
              WHEN doc_id % 8 = 1 THEN 'garbage'
              WHEN doc_id % 8 = 2 THEN '2.' || CAST(doc_id % 3 AS VARCHAR) || '.0'
              WHEN doc_id % 8 = 3 THEN '1.' || CAST(doc_id % 4 AS VARCHAR) || '.0b' || CAST(doc_id % 20 AS VARCHAR)
              WHEN doc_id % 8 = 4 THEN '0.9'
              ELSE '1.' || CAST(doc_id % 4 AS VARCHAR) || '.' || CAST(doc_id % 10 AS VARCHAR) END AS version
  FROM documents),
p AS (SELECT *, CASE WHEN regexp_matches(version, '^(\\d+)\\.(\\d+)')
                     THEN TRY_CAST(regexp_extract(version, '^(\\d+)\\.(\\d+)', 1) AS INTEGER) END AS major,
                CASE WHEN regexp_matches(version, '^(\\d+)\\.(\\d+)')
                     THEN TRY_CAST(regexp_extract(version, '^(\\d+)\\.(\\d+)', 2) AS INTEGER) END AS minor
      FROM fx4),
r AS (SELECT *, CASE WHEN major = 1 AND minor = 1 THEN '1.1' WHEN major = 1 AND minor = 0 THEN '1.0'
                     ELSE 'latest' END AS doc_version FROM p),
cfg AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in DOC_DATASETS)}) t(doc_version, base_url))
SELECT doc_id, source, version, major, minor, doc_version, base_url FROM r JOIN cfg USING (doc_version)""")
def version_route(spark, sf_dir):
    """Version string -> documentation dataset (A10, C9, D3). The 3-row
    dataset config is a fixed-size broadcast."""
    v = fx4_versions(spark, sf_dir)
    major, minor = version_major_minor("version")
    cfg = spark.createDataFrame(DOC_DATASETS, "doc_version string, base_url string")
    out = v.select("doc_id", "source", "version", major.alias("major"), minor.alias("minor"),
                   route_doc_version("version").alias("doc_version"))
    return out.join(F.broadcast(cfg), "doc_version").select(
        "doc_id", "source", "version", "major", "minor", "doc_version", "base_url")


def chunk_index(spark, sf_dir):
    """The documentation chunk index rows: one per kept chunk, with the md5 of
    (conv_id, section_no) as its id."""
    docs = fx1_markdown(spark, sf_dir)
    secs = markdown_sections(docs, "conv_id", "content")
    ch = chunk_sections(secs).join(docs.select("conv_id", "source_file"), "conv_id")
    return ch.select(F.md5(F.concat_ws(":", "conv_id", "section_no")).alias("chunk_id"), "text_chunk", "header",
                     doc_url("source_file", F.lit(DOCS_BASE_URL)).alias("url"), "source_file", "word_length")


CHUNKS_SQL = f"""chunks AS (WITH {SECTIONS_SQL},
c AS (SELECT s.conv_id, s.section_no, s.header, {S.sanitize_links('s.text')} AS text_chunk, d.source_file
      FROM sections s JOIN docs d USING (conv_id))
SELECT md5(conv_id || ':' || section_no) AS chunk_id, conv_id, section_no, text_chunk, coalesce(header, 'N/A') AS header,
       '{DOCS_BASE_URL}' || regexp_replace(source_file, '\\.md$', '') AS url
FROM c WHERE {S.word_count('text_chunk')} >= 10)"""
