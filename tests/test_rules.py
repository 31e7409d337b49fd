"""Rule tests: small inline rows for each branch of the string/parse rules."""
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.parse import judge_scores, query_list, with_eval_fields
from tessera.functions.text import (doc_url, route_doc_version, sanitize_links, trim_ws, version_major_minor,
                                    with_sanitized_links, word_count)
from tessera.functions.vectors import cosine, haversine_km
from tessera.operators.retrieve import metadata_filter
from tessera.operators.sections import chunk_sections, markdown_sections


def one(spark, value, expr, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("text,expected", [
    ("see [the guide](../a/b.md) now", "see the guide now"),
    ("go [here](./x.md)", "go here"),
    ("[anchor](#top) and [site](https://e.com/x.md)", "anchor and [site](https://e.com/x.md)"),
    ("read `api.mdx` first", "read the related documentation first"),
    ("open 'setup.md' please", "open the related documentation please"),
    ("see intro.md, then", "see the related documentation, then"),
    ("ends with intro.md", "ends with the related documentation"),
    ("empty [ ] brackets", "empty  brackets"),
    ("[](x)", "(x)"),
    ("  padded text  ", "padded text"),
    ("plain text", "plain text"),
])
def test_link_rules(spark, text, expected):
    assert one(spark, text, sanitize_links(F.col("x"))) == expected
    staged = with_sanitized_links(spark.createDataFrame([(text,)], "x string"), "x", "y").first()["y"]
    assert staged == expected


def test_long_run_without_spaces_is_linear(spark):
    junk = "A" * 200_000 + ".md"
    assert one(spark, junk, sanitize_links(F.col("x"))) == "the related documentation"


@pytest.mark.parametrize("path,url", [
    ("windows/windows.md", "https://d/windows"),
    ("a/b/c.md", "https://d/a/b/c"),
    ("single.md", "https://d/single"),
    ("/lead/x.md", "https://d/lead/x"),
])
def test_doc_url(spark, path, url):
    assert one(spark, path, doc_url(F.col("x"), F.lit("https://d/"))) == url


@pytest.mark.parametrize("v,route,major,minor", [
    ("1.0.3", "1.0", 1, 0), ("1.1.0", "1.1", 1, 1), ("1.2.0b15", "latest", 1, 2),
    ("garbage", "latest", None, None), (None, "latest", None, None), ("2.1", "latest", 2, 1),
])
def test_version_route(spark, v, route, major, minor):
    df = spark.createDataFrame([(v,)], "x string")
    ma, mi = version_major_minor("x")
    r = df.select(route_doc_version("x").alias("r"), ma.alias("a"), mi.alias("b")).first()
    assert (r["r"], r["a"], r["b"]) == (route, major, minor)


def test_trim_and_words(spark):
    assert one(spark, "\t a b　c \n", trim_ws(F.col("x"))) == "a b　c"
    assert one(spark, " one  two\nthree ", word_count(F.col("x"))) == 3


def _sections(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, content string")
    rows = markdown_sections(df).orderBy("section_no").collect()
    return [(r["header"], r["text"]) for r in rows]


def test_sections_rules(spark):
    text = "intro line\n# One\nbody 1\n```\n# not a header\n```\n## sub stays\n#x stays\n#\nafter bare\n\n# \n"
    got = _sections(spark, text)
    assert got == [
        (None, "intro line"),
        ("# One", "# One\nbody 1\n```\n# not a header\n```\n## sub stays\n#x stays"),
        ("#", "#\nafter bare"),
        ("#", "#"),
    ]


def test_sections_rejoin_gives_lines_back(spark):
    text = "pre\n# A\nx\n# B\ny"
    got = _sections(spark, text)
    assert "\n".join(t for _, t in got) == text


def test_chunks_drop_short(spark):
    secs = spark.createDataFrame([(1, 1, "# H", "# H\n" + " ".join(["w"] * 9)),
                                  (1, 2, None, " ".join(["w"] * 10))],
                                 "doc_id long, section_no long, header string, text string")
    rows = chunk_sections(secs).orderBy("section_no").collect()
    assert [(r["header"], r["word_length"]) for r in rows] == [("# H", 11), ("N/A", 10)]


@pytest.mark.parametrize("answer,expected", [
    ('{"a": 3, "b": 7}', {"a": 3, "b": 7}),
    ('```json\n{"a": 3}\n```', {"a": 3}),
    ('{"a": "5", "b": 2}', {"a": 5, "b": 2}),
    ('{"a": 4.7}', {"a": 4}),
    ('{"a": -4.7, "b": 1e1}', {"a": -4, "b": 10}),
    ('{"a": true, "b": false}', {"a": 1, "b": 0}),
    ('{"a": "7.5", "b": 2}', {}),
    ('{"a": "7.5",\n"b": 2}', {}),
    ('{\n"a": "7.5",\n"b": 2\n}', {"b": 2}),
    ('{"a": null}', {}),
    ('{"a": [1]}', {}),
    ('"a": 7.5,\n"b": +3', {"b": 3}),
    ('"a": 3,\n"b": 9\nnoise', {"a": 3, "b": 9}),
    ('{"a": "n/a", "b": 2}', {}),
    ('[1, 2]', {}),
    ('', {}),
])
def test_judge_parse(spark, answer, expected):
    arr = one(spark, answer, judge_scores(F.col("x")))
    assert {r["model"]: r["score"] for r in arr} == expected


@pytest.mark.parametrize("text,expected", [
    ('["q1", "q2"]', ["q1", "q2"]),
    ("- first\n\n- second \n", ["first", "second"]),
])
def test_query_list(spark, text, expected):
    assert one(spark, text, query_list(F.col("x"))) == expected


@pytest.mark.parametrize("raw,score,expl", [
    ("SCORE: 80\nEXPLANATION: good\nmore\nSCORE: 90", 90, "good\nmore"),
    ("SCORE: high\nEXPLANATION: x", 0, "x"),
    ("nothing here", 0, ""),
    ("EXPLANATION: a\nEXPLANATION: b\nc", 0, "b\nc"),
])
def test_eval_parse(spark, raw, score, expl):
    df = with_eval_fields(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert (df["parsed_score"], df["explanation"]) == (score, expl)


def test_metadata_filter(spark):
    df = spark.createDataFrame([(1, ("a", True, 3)), (2, ("b", False, 3))],
                               "id int, metadata struct<s:string,b:boolean,n:int>")
    assert [r.id for r in df.filter(metadata_filter({"s": "a"})).collect()] == [1]
    assert [r.id for r in df.filter(metadata_filter({"b": False})).collect()] == [2]
    assert df.filter(metadata_filter({"n": 3, "b": True})).count() == 1
    assert metadata_filter({}) is None
    with pytest.raises(ValueError):
        metadata_filter({"s": [1]})


def test_cosine_example(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], [0.0, 1.0, 1.0])], "a array<double>, b array<double>")
    assert math.isclose(df.select(cosine("a", "b")).first()[0], 0.5)


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    assert math.isclose(df.select(haversine_km("a", "b", "c", "d")).first()[0], 111.19, rel_tol=1e-3)
