"""Declared types and typed request rows."""
import pytest

from tessera.operators.services import declared_type, typed_requests


@pytest.mark.parametrize("decl,ddl", [
    ("Int64", "bigint"), ("Float32", "float"), ("Timestamp", "timestamp"), ("Array(Int32)", "array<int>"),
    ("Map(String, Array(Map(Int64, Bool)))", "map<string,array<map<bigint,boolean>>>"),
    ("Struct(a: Int64)", "map<string,variant>"), ("Struct", "map<string,variant>"), ("Money", "variant"),
    ("Array(Money)", "array<variant>"), (" Array( Float64 ) ", "array<double>"), ("Array(Int64", "variant"),
])
def test_declared_type(spark, decl, ddl):
    assert declared_type(decl).simpleString() == ddl


CASES = [
    ("Int64", "7", 7), ("Int64", '"7"', 7), ("Int64", "7.5", None), ("Int64", "true", None), ("Int64", "null", None),
    ("Int32", "3000000000", None), ("Float64", "7", 7.0), ("Float64", '"x"', None), ("String", '"a"', "a"),
    ("String", "5", None), ("Bool", "true", True), ("Bool", '"true"', None), ("Array(Int64)", "[1, 2]", [1, 2]),
    ("Array(Int64)", "[]", []), ("Array(Int64)", '[1, "x"]', None), ("Array(Int64)", "{}", None),
    ("Array(Array(Bool))", "[[true], []]", [[True], []]), ("Map(Int64, Float64)", '{"1": 2}', {1: 2.0}),
    ("Map(Int64, Float64)", '{"a": 2}', None), ("Map(String, Int64)", '{"a": 1.5}', None),
]


@pytest.mark.parametrize("decl,value,want", CASES)
def test_values(spark, decl, value, want):
    df = spark.createDataFrame([(1, f'{{"f": {value}, "other": 1}}')], "id long, body string")
    row = typed_requests(df, {"f": decl}).first()
    assert row["f"] == want
    assert [tuple(r) for r in row["rejects"]] == ([] if want is not None else [("f", f"not {decl}")])


def test_rows_that_are_no_object(spark):
    df = spark.createDataFrame([(1, None), (2, "oops"), (3, "[1]"), (4, "{}"), (None, '{"f": 1}'), (5, "")],
                               "id long, body string")
    rows = {r["id"]: (r["f"], [tuple(x) for x in r["rejects"]]) for r in typed_requests(df, {"f": "Int64"}).collect()}
    bad = (None, [("", "not a JSON object")])
    assert rows == {1: bad, 2: bad, 3: bad, 5: bad, 4: (None, [("f", "missing")]), None: (1, [])}


def test_clash_and_empty(spark):
    df = spark.createDataFrame([], "id long, body string")
    assert typed_requests(df, {"f": "Int64"}).count() == 0
    with pytest.raises(ValueError, match="clash"):
        typed_requests(df, {"ID": "Int64"})
