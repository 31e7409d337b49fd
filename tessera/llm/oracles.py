"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from tessera.llm.quality_rules import RULES, STOP_WORDS


def _verdict() -> str:
    return " AND ".join(f"100 * {r.part} {r.op} {r.percent} * {r.whole}" for r in RULES)


QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, rid, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n >= 2),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             len([x for x in ws if lower(x) IN (STOPS)]) AS n_stop_words,
             len(ls) AS n_lines,
             len([x for x in ls if regexp_matches(x, '(\.\.\.|…)\s*$')]) AS n_ellipsis_lines,
             len([x for x in ls if regexp_matches(x, '^\s*[-*•]\s')]) AS n_bullet_lines
      FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND VERDICT AS kept FROM f
""".replace("STOPS", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))).replace("VERDICT", _verdict())

# 24 bits are more than the shards of any table this statement can be run on need.
SHARDING = r"""
WITH h AS (SELECT doc_id, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(text, ''))) AS hash,
                  CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
b AS (SELECT *, right('000000000000000000000000' || bin(CAST('0x' || substr(hash, 1, 6) AS BIGINT)), 24) AS bits FROM h),
p AS (SELECT *, substr(bits, 1, d) AS prefix FROM b, (SELECT unnest(range(0, 25)) AS d)),
s AS (SELECT d, prefix, sum(n_bytes) AS bytes, count(*) AS n FROM p GROUP BY ALL),
k AS (SELECT doc_id, hash, n_bytes, min(d) AS depth FROM p JOIN s USING (d, prefix)
      WHERE bytes <= {limit} OR n = 1 GROUP BY ALL)
SELECT doc_id, hash, n_bytes, CAST(depth AS INTEGER) AS depth, prefix AS shard, bytes > {limit} AS oversized
FROM k JOIN p USING (doc_id, hash, n_bytes) JOIN s USING (d, prefix) WHERE p.d = k.depth
"""

# The checksum is the reflected CRC-32 of polynomial 0xEDB88320.
SPELLING_VARIANTS = r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              AS c FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents),
b AS (SELECT run, count(*) AS times, list_transform(regexp_extract_all(hex(encode(
             coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
      FROM r GROUP BY doc_id, run),
h AS (SELECT run, times, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]), 4294967295),
                             4294967295) AS h FROM b, tab),
w AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                         ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word
                   HAVING sum(times) >= 2),
d AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS s
      FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS MATERIALIZED (SELECT d.word, v.word AS other FROM d JOIN v ON d.s = v.word
         UNION SELECT v.word, d.word FROM d JOIN v ON d.s = v.word
         UNION SELECT x.word, y.word FROM d x JOIN d y ON x.p = y.p AND x.s = y.s AND x.word <> y.word),
f AS MATERIALIZED (SELECT word, other AS form, m AS form_n, n_near FROM (
        SELECT near.word, other, o.n AS m, own.n AS n, count(*) OVER (PARTITION BY near.word) AS n_near,
               row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
        FROM near JOIN v o ON o.word = other JOIN v own ON own.word = near.word) WHERE place = 1),
g AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
                          CASE WHEN form_n >= 10 * v.n THEN form END AS form,
                          CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word)),
walk AS (SELECT word, word AS at FROM g UNION ALL
         SELECT walk.word, g.form FROM walk JOIN g ON g.word = walk.at WHERE g.form IS NOT NULL)
SELECT g.word, g.form, walk.at AS root, g.n, g.n_near, g.form_n
FROM g JOIN walk USING (word) JOIN g last ON last.word = walk.at WHERE last.form IS NULL
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
m AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST) AS place,
             max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN strlen(t) >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(t) >= 1000 AND place > 1 THEN top END AS refers_to
FROM m
"""
