"""Parsers for model / tool outputs, as column expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import LINE_BREAK, trim_ws

# The markers the parsers look for.
FENCE_OPEN = "```json"
FENCE_CLOSE = "```"
SCORE_TAG = "SCORE:"
EXPLANATION_TAG = "EXPLANATION:"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_json_fence(x) -> Column:
    """Strip; drop a leading ```json and a trailing ```; strip again."""
    t = trim_ws(_c(x))
    t = F.when(t.startswith(FENCE_OPEN), F.substring(t, len(FENCE_OPEN) + 1, 1 << 30)).otherwise(t)
    t = F.when(t.endswith(FENCE_CLOSE), F.left(t, F.length(t) - F.lit(len(FENCE_CLOSE)))).otherwise(t)
    return trim_ws(t)


def judge_scores(answer) -> Column:
    """Judge answer -> array<struct<model string, score int, pos int>>.

    JSON path: the cleaned text is a JSON object whose every value converts
    to an integer by its JSON type (``_int_of``). Otherwise, line by line:
    split at the first ':', strip the key of white space, quotes and spaces,
    strip the value and trailing commas, keep whole numbers. ``pos`` orders
    duplicates (later lines win).
    """
    t = strip_json_fence(answer)
    m = F.from_json(t, "map<string,variant>")
    entries = F.transform(F.map_entries(m), lambda e: F.struct(
        e["key"].alias("model"), _int_of(e["value"]).alias("score")))
    json_ok = m.isNotNull() & F.forall(entries, lambda e: e["score"].isNotNull())
    json_rows = F.transform(entries, lambda e, i: F.struct(
        e["model"].alias("model"), e["score"].alias("score"), i.alias("pos")))
    lines = F.split(t, LINE_BREAK, -1)
    with_colon = F.filter(F.transform(lines, lambda l, i: F.struct(l.alias("l"), i.alias("pos"))),
                          lambda s: F.contains(s["l"], F.lit(":")))
    parsed = F.transform(with_colon, lambda s: F.struct(
        F.regexp_replace(trim_ws(F.substring_index(s["l"], ":", 1)), '^[" ]+|[" ]+$', "").alias("model"),
        _whole(F.regexp_replace(trim_ws(_after_first(s["l"], ":")), ",+$", "")).alias("score"),
        s["pos"].alias("pos")))
    line_rows = F.filter(parsed, lambda s: s["score"].isNotNull())
    return F.when(json_ok, json_rows).otherwise(line_rows)


def _after_first(s: Column, sep: str) -> Column:
    """Everything after the first ``sep`` (the text itself contains it)."""
    return F.substring(s, F.instr(s, sep) + len(sep), 1 << 30)


def _whole(text: Column) -> Column:
    """A signed run of digits, white space around it aside, as an integer."""
    t = trim_ws(text)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("int"))


def _int_of(v: Column) -> Column:
    """Integer of a JSON scalar (a variant): numbers are cut to their whole
    part, true is 1 and false 0, strings must hold a whole number; null,
    arrays and objects have none."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return (F.when(kind == "STRING", _whole(text))
            .when(kind == "BOOLEAN", F.when(text == "true", F.lit(1)).otherwise(F.lit(0)))
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), text.try_cast("double").try_cast("int")))


def query_list(text) -> Column:
    """A JSON array of strings, else the non-blank lines stripped of '- '."""
    arr = F.from_json(_c(text), "array<string>")
    lines = F.transform(F.split(_c(text), LINE_BREAK, -1),
                        lambda l: F.regexp_replace(l, "^[- ]+|[- ]+$", ""))
    raw_lines = F.split(_c(text), LINE_BREAK, -1)
    kept = F.filter(F.arrays_zip(raw_lines.alias("r"), lines.alias("s")),
                    lambda z: trim_ws(z["r"]) != "")
    return F.coalesce(arr, F.transform(kept, lambda z: z["s"]))


def eval_score(text) -> Column:
    """Integer after the last line starting with 'SCORE:'; bad or none -> 0."""
    lines = F.split(trim_ws(_c(text)), "\n", -1)
    last = F.try_element_at(F.filter(lines, lambda l: l.startswith(SCORE_TAG)), F.lit(-1))
    return F.coalesce(trim_ws(F.replace(last, F.lit(SCORE_TAG), F.lit(""))).try_cast("int"), F.lit(0))


def eval_explanation(text) -> Column:
    """Text after the last 'EXPLANATION:' line plus the following lines up
    to the next 'SCORE:' line, stripped. As in the source rule, the start is
    the first line equal to that last explanation line."""
    lines = F.split(trim_ws(_c(text)), "\n", -1)
    last = F.try_element_at(F.filter(lines, lambda l: l.startswith(EXPLANATION_TAG)), F.lit(-1))
    pos = F.array_position(lines, last)
    tail = F.slice(lines, pos + 1, F.greatest(F.size(lines) - pos, F.lit(1)))
    tail = F.when(pos < F.size(lines), tail).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(tail, lambda l: l.startswith(SCORE_TAG)), True)
    taken = F.when(stop == 0, tail).otherwise(
        F.when(stop > 1, F.slice(tail, 1, F.greatest(stop - 1, F.lit(1))))
        .otherwise(F.array().cast("array<string>")))
    first = trim_ws(F.replace(last, F.lit(EXPLANATION_TAG), F.lit("")))
    return F.when(last.isNull(), F.lit("")).otherwise(
        trim_ws(F.array_join(F.concat(F.array(first), taken), "\n")))


def declarations(answer) -> Column:
    """Structured extraction answer -> array<array<string>>; malformed -> null."""
    return F.from_json(_c(answer), "struct<declarations: array<array<string>>>")["declarations"]


def with_eval_fields(df, raw: str, score_out: str = "parsed_score",
                     explanation_out: str = "explanation"):
    """DataFrame form of ``eval_score`` + ``eval_explanation``: the lines
    and every intermediate array are computed once, one projection each
    (higher-order functions run interpreted, so repeating them is costly)."""
    df = df.withColumn("_lines", F.split(trim_ws(raw), "\n", -1))
    df = (df.withColumn("_ls", F.try_element_at(F.filter("_lines", lambda l: l.startswith(SCORE_TAG)), F.lit(-1)))
            .withColumn("_le", F.try_element_at(F.filter("_lines", lambda l: l.startswith(EXPLANATION_TAG)), F.lit(-1))))
    df = df.withColumn("_pos", F.array_position("_lines", F.col("_le")))
    n = F.size("_lines")
    df = df.withColumn("_tail", F.when(F.col("_pos") < n, F.slice("_lines", F.col("_pos") + 1, n - F.col("_pos")))
                       .otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_stop", F.array_position(F.transform("_tail", lambda l: l.startswith(SCORE_TAG)), True))
    taken = (F.when(F.col("_stop") == 0, F.col("_tail"))
             .when(F.col("_stop") > 1, F.slice("_tail", 1, F.greatest(F.col("_stop") - 1, F.lit(1))))
             .otherwise(F.array().cast("array<string>")))
    first = trim_ws(F.replace(F.col("_le"), F.lit(EXPLANATION_TAG), F.lit("")))
    df = df.withColumn(score_out, F.coalesce(
        trim_ws(F.replace(F.col("_ls"), F.lit(SCORE_TAG), F.lit(""))).try_cast("int"), F.lit(0)))
    df = df.withColumn(explanation_out, F.when(F.col("_le").isNull(), F.lit("")).otherwise(
        trim_ws(F.array_join(F.concat(F.array(first), taken), "\n"))))
    return df.drop("_lines", "_ls", "_le", "_pos", "_tail", "_stop")
