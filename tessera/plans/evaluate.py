"""Evaluation, test-summary and example-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.parse import declarations
from tessera.functions.text import trim_ws
from tessera.operators.evaluate import (all_passed, failures, model_stats, parse_judgements, run_summary,
                                        score_results)
from tessera.plans import sqltext as S
from tessera.plans.registry import register
from tessera.sources.tables import read_table

# The retrievers under test ('random' is tested but never judged).
TESTED_MODELS = ["click", "error", "purchase", "signup", "view", "random"]


# FX9: one judge answer per user; each event type is a "model" scored
# floor(max value) % 10 + 1. Clean JSON, fenced JSON or loose lines by user;
# some answers quote a value, hold an unparsable value, a fraction (bare or
# quoted), a truth value or an untested model.
def fx9_answers(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "user_id", "event_type", "value")
    sc = ev.groupBy("user_id", "event_type").agg(
        ((F.floor(F.max("value")) % 10) + 1).cast("int").alias("score"))
    u = F.col("user_id")
    val = (F.when((u % 7 == 0) & (F.col("event_type") == "click"),
                  F.concat(F.lit('"'), F.col("score").cast("string"), F.lit('"')))
           .when((u % 11 == 0) & (F.col("event_type") == "view"), F.lit('"n/a"'))
           .when((u % 13 == 0) & (F.col("event_type") == "signup"), F.lit('"7.5"'))
           .when((u % 17 == 0) & (F.col("event_type") == "purchase"), F.lit("true"))
           .when((u % 8 == 0) & (F.col("event_type") == "error"), F.concat(F.col("score").cast("string"), F.lit(".75")))
           .otherwise(F.col("score").cast("string")))
    entry = F.concat(F.lit('"'), F.col("event_type"), F.lit('": '), val)
    extra = ev.select("user_id").distinct().filter(u % 5 == 0) \
        .select("user_id", F.lit("zz_bm25").alias("event_type"), F.lit('"bm25": 4').alias("entry"))
    entries = sc.select("user_id", "event_type", entry.alias("entry")).unionByName(extra)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "entry"))), lambda x: x["entry"])
    g = entries.groupBy("user_id").agg(F.array_join(ordered, ", ").alias("body"),
                                       F.array_join(ordered, ",\n").alias("loose"))
    body = F.concat(F.lit("{"), F.col("body"), F.lit("}"))
    answer = (F.when(u % 3 == 0, body)
              .when(u % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
              .otherwise(F.col("loose")))
    return g.select(F.col("user_id").alias("query_id"), answer.alias("answer"))


FX9_SQL = """sc AS (SELECT user_id, event_type, CAST((floor(max(value)) % 10) + 1 AS INTEGER) AS score
       FROM events GROUP BY user_id, event_type),
en AS (SELECT user_id, event_type,
              '"' || event_type || '": ' ||
              CASE WHEN user_id % 7 = 0 AND event_type = 'click' THEN '"' || CAST(score AS VARCHAR) || '"'
                   WHEN user_id % 11 = 0 AND event_type = 'view' THEN '"n/a"'
                   WHEN user_id % 13 = 0 AND event_type = 'signup' THEN '"7.5"'
                   WHEN user_id % 17 = 0 AND event_type = 'purchase' THEN 'true'
                   WHEN user_id % 8 = 0 AND event_type = 'error' THEN CAST(score AS VARCHAR) || '.75'
                   ELSE CAST(score AS VARCHAR) END AS entry FROM sc
       UNION ALL SELECT DISTINCT user_id, 'zz_bm25', '"bm25": 4' FROM events WHERE user_id % 5 = 0),
g AS (SELECT user_id, string_agg(entry, ', ' ORDER BY event_type) AS body,
             string_agg(entry, ',' || chr(10) ORDER BY event_type) AS loose FROM en GROUP BY user_id),
fx9 AS (SELECT user_id AS query_id,
               CASE WHEN user_id % 3 = 0 THEN '{' || body || '}'
                    WHEN user_id % 3 = 1 THEN '```json' || chr(10) || '{' || body || '}' || chr(10) || '```'
                    ELSE loose END AS answer FROM g)"""

_T3 = ("trim3 AS (SELECT query_id, " + S.trim_ws(
    "CASE WHEN ends_with(t1, '```') THEN left(t1, length(t1) - 3) ELSE t1 END") + " AS t FROM ("
    "SELECT query_id, CASE WHEN starts_with(t0, '```json') THEN substr(t0, 8) ELSE t0 END AS t1 FROM ("
    "SELECT query_id, " + S.trim_ws("answer") + " AS t0 FROM fx9)))")

JUDGE_SQL = f"""{FX9_SQL}, {_T3},
js AS (SELECT query_id, t, json_valid(t) AND json_type(t) = 'OBJECT' AS is_obj FROM trim3),
jv AS (SELECT query_id, t, k, pos,
              CASE WHEN kind = 'VARCHAR' AND regexp_full_match(trim(v), '[+-]?[0-9]+') THEN TRY_CAST(trim(v) AS INTEGER)
                   WHEN kind = 'BOOLEAN' THEN CASE WHEN v = 'true' THEN 1 ELSE 0 END
                   WHEN kind IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN TRY_CAST(trunc(TRY_CAST(v AS DOUBLE)) AS INTEGER)
                   END AS score
       FROM (SELECT query_id, t, k, pos, json_extract_string(t, '$."' || k || '"') AS v,
                    json_type(t, '$."' || k || '"') AS kind
             FROM (SELECT query_id, t, unnest(json_keys(t)) AS k, generate_subscripts(json_keys(t), 1) AS pos
                   FROM js WHERE is_obj))),
jok AS (SELECT query_id FROM js WHERE is_obj
        AND query_id NOT IN (SELECT query_id FROM jv WHERE score IS NULL)),
ln AS (SELECT query_id, unnest(string_split_regex(t, {S.q(S.LINE_BREAK)})) AS l,
              generate_subscripts(string_split_regex(t, {S.q(S.LINE_BREAK)}), 1) AS pos
       FROM trim3 WHERE query_id NOT IN (SELECT query_id FROM jok)),
lp AS (SELECT query_id, pos, k, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN TRY_CAST(v AS INTEGER) END AS score
       FROM (SELECT query_id, pos,
                    regexp_replace({S.trim_ws("split_part(l, ':', 1)")}, '^[" ]+|[" ]+$', '', 'g') AS k,
                    {S.trim_ws("regexp_replace(" + S.trim_ws("substr(l, strpos(l, ':') + 1)") + ", ',+$', '')")} AS v
             FROM ln WHERE contains(l, ':'))),
allrows AS (SELECT query_id, k AS model, score, pos FROM jv WHERE query_id IN (SELECT query_id FROM jok)
            UNION ALL SELECT query_id, k, score, pos FROM lp WHERE score IS NOT NULL),
judged AS (SELECT query_id, model, arg_max(score, pos) AS score FROM allrows GROUP BY query_id, model)"""


@register("judge_parse", sql=f"WITH {JUDGE_SQL} SELECT query_id, model, score FROM judged")
def judge_parse(spark, sf_dir):
    """Judge answers -> (query, model, score): fences, JSON, line fallback."""
    return parse_judgements(fx9_answers(spark, sf_dir)).select("query_id", "model", "score")


_models = ", ".join(f"({S.q(m)})" for m in TESTED_MODELS)


@register("model_scores", sql=f"""WITH {JUDGE_SQL},
models AS (SELECT * FROM (VALUES {_models}) t(model)),
agg AS (SELECT model, avg(score) AS mean, median(score) AS median, count(score) AS n
        FROM judged WHERE model IN (SELECT model FROM models) GROUP BY model)
SELECT model, round(mean, 6) AS mean, round(median, 6) AS median, coalesce(n, 0) AS n
FROM models LEFT JOIN agg USING (model)""")
def model_scores(spark, sf_dir):
    """Mean / median / count per tested retriever."""
    judged = parse_judgements(fx9_answers(spark, sf_dir))
    models = spark.createDataFrame([(m,) for m in TESTED_MODELS], "model string")
    out = model_stats(judged, F.broadcast(models))
    return out.select("model", F.round("mean", 6).alias("mean"),
                      F.round(F.col("median").cast("double"), 6).alias("median"), "n")


# FX10: one test result per event, half simple, half full, with raw
# evaluation text (bad SCORE lines, repeated SCORE lines, multi-line
# explanations) and a skip flag.
def fx10_results(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props")
    k = F.col("event_id")
    nl = F.lit("\n")
    score_line = F.when(k % 9 == 0, F.lit("SCORE: high")).otherwise(
        F.concat(F.lit("SCORE: "), (F.floor(F.col("value") * 7) % 101).cast("string")))
    raw = F.concat(F.lit("Review for case "), k.cast("string"), nl, score_line, nl,
                   F.lit("EXPLANATION: "), F.col("event_type"), F.lit(" flow checked"), nl,
                   F.lit("user "), F.col("user_id").cast("string"), F.lit(" props "), F.col("props"),
                   F.when(k % 4 == 1, F.concat(nl, F.lit("SCORE: "), (F.col("user_id") % 100).cast("string")))
                   .otherwise(F.lit("")))
    return ev.select(F.concat(F.lit("case_"), k.cast("string")).alias("test_name"),
                     F.when(k % 2 == 0, F.lit("simple")).otherwise(F.lit("integration")).alias("test_type"),
                     raw.alias("raw"),
                     F.concat(F.lit("Answer: "), F.when(F.col("value") >= 25, F.lit(" Yes ")).otherwise(F.lit("no")))
                     .alias("stdout"),
                     F.lit("YES").alias("expected_response"),
                     (F.col("event_type") != "error").alias("ran"),
                     (F.col("user_id") % 4 != 0).alias("plan_passed"),
                     (F.col("user_id") % 5 != 0).alias("plan_should_pass"),
                     (F.col("value") < 1.0).alias("skip"))


FX10_SQL = """fx10 AS (
  SELECT 'case_' || CAST(event_id AS VARCHAR) AS test_name,
         CASE WHEN event_id % 2 = 0 THEN 'simple' ELSE 'integration' END AS test_type,
         'Review for case ' || CAST(event_id AS VARCHAR) || chr(10) ||
         CASE WHEN event_id % 9 = 0 THEN 'SCORE: high'
              ELSE 'SCORE: ' || CAST(CAST(floor(value * 7) AS BIGINT) % 101 AS VARCHAR) END || chr(10) ||
         'EXPLANATION: ' || event_type || ' flow checked' || chr(10) ||
         'user ' || CAST(user_id AS VARCHAR) || ' props ' || props ||
         CASE WHEN event_id % 4 = 1 THEN chr(10) || 'SCORE: ' || CAST(user_id % 100 AS VARCHAR) ELSE '' END AS raw,
         'Answer: ' || CASE WHEN value >= 25 THEN ' Yes ' ELSE 'no' END AS stdout,
         'YES' AS expected_response,
         event_type <> 'error' AS ran, user_id % 4 <> 0 AS plan_passed, user_id % 5 <> 0 AS plan_should_pass,
         value < 1.0 AS skip
  FROM events)"""

_LINES = f"string_split({S.trim_ws('raw')}, chr(10))"
SCORED_SQL = f"""{FX10_SQL},
p AS (SELECT *, {_LINES} AS lines FROM fx10),
p2 AS (SELECT *, list_filter(lines, lambda l: starts_with(l, 'SCORE:'))[-1] AS last_score,
              list_filter(lines, lambda l: starts_with(l, 'EXPLANATION:'))[-1] AS last_expl FROM p),
p3 AS (SELECT *, coalesce(TRY_CAST({S.trim_ws("replace(last_score, 'SCORE:', '')")} AS INTEGER), 0) AS parsed,
              list_position(lines, last_expl) AS epos FROM p2),
p4 AS (SELECT *, CASE WHEN epos < len(lines) THEN lines[epos + 1:] ELSE [] END AS tail FROM p3),
p5 AS (SELECT *, coalesce(list_position(list_transform(tail, lambda l: starts_with(l, 'SCORE:')), true), 0) AS stop
       FROM p4),
p6 AS (SELECT *, CASE WHEN stop = 0 THEN tail WHEN stop > 1 THEN tail[1:stop - 1] ELSE [] END AS taken FROM p5),
scored AS (
  SELECT test_name, test_type, skip,
         CASE WHEN test_type = 'simple'
              THEN CASE WHEN contains(lower({S.trim_ws('stdout')}), lower({S.trim_ws('expected_response')}))
                        THEN 100 ELSE 0 END
              ELSE parsed END AS score,
         CASE WHEN test_type = 'simple' THEN ''
              WHEN last_expl IS NULL THEN ''
              ELSE {S.trim_ws("array_to_string(list_concat([" + S.trim_ws("replace(last_expl, 'EXPLANATION:', '')") + "], taken), chr(10))")}
         END AS explanation,
         CASE WHEN test_type = 'simple'
              THEN contains(lower({S.trim_ws('stdout')}), lower({S.trim_ws('expected_response')}))
              ELSE ran AND parsed >= 70 AND (plan_passed OR NOT plan_should_pass) END AS success
  FROM p6)"""


@register("score_parse", sql=f"WITH {SCORED_SQL} SELECT test_name, test_type, score, explanation, success FROM scored")
def score_parse(spark, sf_dir):
    """SCORE / EXPLANATION parsing and pass rules per test."""
    return score_results(fx10_results(spark, sf_dir)).drop("skip")


@register("run_summary", sql=f"""WITH {SCORED_SQL}
SELECT test_type, count(*) AS total, count(*) FILTER (WHERE success) AS passed,
       count(*) - count(*) FILTER (WHERE success) AS failed,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE success) * 100.0 / count(*), 1) END AS success_rate
FROM scored WHERE NOT skip GROUP BY ROLLUP (test_type)""")
def run_summary_q(spark, sf_dir):
    """Skip flag, then totals per type and overall."""
    res = fx10_results(spark, sf_dir).filter(~F.col("skip"))
    return run_summary(score_results(res).drop("skip"))


@register("run_failures", sql=f"""WITH {SCORED_SQL}
SELECT test_name, test_type, score, explanation FROM scored WHERE NOT skip AND success IS NOT TRUE""")
def run_failures(spark, sf_dir):
    """The failed tests of a run, one row each (H2)."""
    return failures(score_results(fx10_results(spark, sf_dir).filter(~F.col("skip"))))


@register("run_overall", sql=f"""WITH {SCORED_SQL}
SELECT test_type, bool_and(coalesce(success, false)) AS all_passed FROM scored WHERE NOT skip
GROUP BY GROUPING SETS ((), (test_type))""")
def run_overall(spark, sf_dir):
    """Whether all tests passed, of each type and in all (H2)."""
    return all_passed(score_results(fx10_results(spark, sf_dir).filter(~F.col("skip"))))


# FX8: one extraction answer per order (its lines' [returnflag, linestatus]
# pairs; line 3 gives a 1-element pair; every 13th answer is malformed) and
# a small code file per order; urgent orders come from the "native" folder.
def fx8_files(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    pair = F.when(F.col("l_linenumber") == 3, F.concat(F.lit('["'), F.col("l_returnflag"), F.lit('"]'))) \
        .otherwise(F.concat(F.lit('["'), F.col("l_returnflag"), F.lit('", "'), F.col("l_linestatus"), F.lit('"]')))
    ans = li.groupBy("l_orderkey").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", pair.alias("p")))),
        lambda x: x["p"]), ", ")
        .alias("pairs"))
    answer = F.when(F.col("o_orderkey") % 13 == 0,
                    F.concat(F.lit('{"declarations": [['), F.col("pairs")))
    answer = answer.otherwise(F.concat(F.lit('{"declarations": ['), F.col("pairs"), F.lit("]}")))
    code = F.concat(F.lit("# order "), F.col("o_orderkey").cast("string"), F.lit("\nstatus = '"),
                    F.col("o_orderstatus"), F.lit("'\npriority = '"), F.col("o_orderpriority"), F.lit("'\n"))
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("native")).otherwise(F.lit("spark"))
    return (o.join(ans, o["o_orderkey"] == ans["l_orderkey"])
            .select("o_orderkey", answer.alias("answer"), code.alias("code"), kind.alias("directory_type")))


@register("example_rows", sql="""WITH a AS (
  SELECT l_orderkey, string_agg(CASE WHEN l_linenumber = 3 THEN '["' || l_returnflag || '"]'
                                     ELSE '["' || l_returnflag || '", "' || l_linestatus || '"]' END,
                                ', ' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS pairs
  FROM lineitem GROUP BY l_orderkey),
fx8 AS (SELECT o_orderkey,
               CASE WHEN o_orderkey % 13 = 0 THEN '{"declarations": [[' || pairs
                    ELSE '{"declarations": [' || pairs || ']}' END AS answer,
               '# order ' || CAST(o_orderkey AS VARCHAR) || chr(10) || 'status = ''' || o_orderstatus || '''' || chr(10)
               || 'priority = ''' || o_orderpriority || '''' || chr(10) AS code,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'native' ELSE 'spark' END AS directory_type
        FROM orders JOIN a ON o_orderkey = l_orderkey),
ok AS (SELECT * FROM fx8 WHERE json_valid(answer)),
d AS (SELECT o_orderkey, code, directory_type,
             CAST(json_extract(answer, '$.declarations') AS VARCHAR[][]) AS decl FROM ok),
u AS (SELECT o_orderkey, code, directory_type, unnest(decl) AS item, generate_subscripts(decl, 1) AS pos FROM d)
SELECT o_orderkey, CAST(pos - 1 AS INTEGER) AS pos, 'Example of ' || item[1] || '. ' || item[2] AS text,
       code, directory_type
FROM u WHERE len(item) >= 2 AND length(""" + S.trim_ws("code") + """) >= 50""")
def example_rows(spark, sf_dir):
    """Code files -> extraction answers -> one labelled example per
    declaration of at least two parts; short files skipped (B1, B5, C5, C15, D2, A6, I4)."""
    f = fx8_files(spark, sf_dir).filter(F.length(trim_ws("code")) >= 50)
    ex = f.select("o_orderkey", "code", "directory_type", F.posexplode(declarations("answer")).alias("pos", "d"))
    ex = ex.filter(F.size("d") >= 2)
    text = F.concat(F.lit("Example of "), F.element_at("d", 1), F.lit(". "), F.element_at("d", 2))
    return ex.select("o_orderkey", "pos", text.alias("text"), "code", "directory_type")


@register("small_file_filter", sql=f"""WITH f AS (
  SELECT CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'native' ELSE 'spark' END AS directory_type,
         source, text FROM documents)
SELECT directory_type, source, count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM f WHERE length({S.trim_ws('text')}) >= 50 GROUP BY directory_type, source""")
def small_file_filter(spark, sf_dir):
    """Files per folder kind, tiny files (stripped < 50 chars) skipped (A2, B1, H3)."""
    d = read_table(spark, sf_dir, "documents", "source", "text")
    kind = F.when(F.expr("substring(source, 4)").try_cast("int") % 2 == 0, F.lit("native")).otherwise(F.lit("spark"))
    return (d.filter(F.length(trim_ws("text")) >= 50)
            .groupBy(kind.alias("directory_type"), "source")
            .agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("text")).cast("long").alias("n_chars")))


@register("corpus_upsert", sql="""WITH r AS (
  SELECT md5(text) AS id, doc_id, count(*) OVER (PARTITION BY md5(text)) AS n_copies,
         row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS rn
  FROM documents)
SELECT id, doc_id, n_copies FROM r WHERE rn = 1""")
def corpus_upsert(spark, sf_dir):
    """Content ids (md5 of the text) and upsert: one row per id, the newest
    (largest doc_id) wins (A7, A8, H5). max_by aggregates map-side, so a text
    copied a million times reduces before the shuffle."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return (d.select(F.md5("text").alias("id"), "doc_id")
            .groupBy("id").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies")))


@register("query_list_parse", sql=f"""WITH ql AS (
  SELECT event_id // 10 AS list_id,
         CASE WHEN (event_id // 10) % 2 = 0
              THEN '[' || string_agg('"' || event_type || ' near ' || CAST(event_id AS VARCHAR) || '"', ', ' ORDER BY event_id) || ']'
              ELSE string_agg('- ' || event_type || ' near ' || CAST(event_id AS VARCHAR), chr(10) || chr(10) ORDER BY event_id)
         END AS txt
  FROM events GROUP BY event_id // 10),
arr AS (SELECT list_id, CASE WHEN json_valid(txt) AND json_type(txt) = 'ARRAY'
                             THEN CAST(json_extract(txt, '$') AS VARCHAR[]) END AS a, txt FROM ql),
lines AS (SELECT list_id, coalesce(a, list_transform(list_filter(string_split_regex(txt, {S.q(S.LINE_BREAK)}),
                                                                 lambda l: {S.trim_ws('l')} <> ''),
                                                     lambda l: regexp_replace(l, '^[- ]+|[- ]+$', '', 'g'))) AS qs
          FROM arr)
SELECT list_id, CAST(pos AS INTEGER) AS pos, q AS query
FROM (SELECT list_id, unnest(qs) AS q, generate_subscripts(qs, 1) - 1 AS pos FROM lines)""")
def query_list_parse(spark, sf_dir):
    """Generated query lists (up to 10 queries each, by blocks of event
    ids): a JSON array, else non-blank lines without '- ' (C11)."""
    from tessera.functions.parse import query_list
    ev = read_table(spark, sf_dir, "events", "event_id", "event_type")
    item = F.concat(F.col("event_type"), F.lit(" near "), F.col("event_id").cast("string"))
    srt = F.array_sort(F.collect_list(F.struct("event_id", item.alias("q"))))
    g = ev.groupBy((F.col("event_id") / 10).cast("long").alias("list_id")).agg(
        F.concat(F.lit("["), F.array_join(F.transform(srt, lambda x: F.concat(F.lit('"'), x["q"], F.lit('"'))), ", "),
                 F.lit("]")).alias("js"),
        F.array_join(F.transform(srt, lambda x: F.concat(F.lit("- "), x["q"])), "\n\n").alias("bl"))
    txt = F.when(F.col("list_id") % 2 == 0, F.col("js")).otherwise(F.col("bl"))
    return g.select("list_id", F.posexplode(query_list(txt)).alias("pos", "query"))
