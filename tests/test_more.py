"""Catalogue text, annotation edges, case validation, example extraction."""
import pytest

from tessera.operators.catalog import catalog_text
from tessera.operators.evaluate import case_violations, runnable_cases
from tessera.operators.examples import extract_examples, json_extractor
from tessera.operators.graph import annotation_edges


def test_catalog_text(spark):
    cat = spark.createDataFrame([("b", "Function", "pkg.m", "pkg", "def b()"), ("a", "Class", "pkg.n", "pkg.n", "class a")],
                                "name string, type string, module string, import_from string, declaration string")
    t = catalog_text(cat).first().text
    assert t.startswith("Found the following public classes/functions:\n- a\n- b\n")
    assert t.index("Class: a\nImport from: pkg.n (defined in: pkg.n)") < t.index("Function: b")


def test_annotation_edges(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    ann = spark.createDataFrame([("A", "Union[B, int, C]"), ("A", "B"), ("B", "Optional[C]"), ("C", "str")],
                                "src string, type_name string")
    got = sorted((r.src, r.dst) for r in annotation_edges(ann, nodes).collect())
    assert got == [("A", "B"), ("A", "C"), ("B", "C")]


def test_case_validation(spark):
    cases = spark.createDataFrame([("ok", True, "YES", False, False), ("repo", True, "", True, False),
                                   ("skipped", False, "", False, True)],
                                  "name string, has_prompt boolean, expected_response string, has_expected_repo boolean, skip boolean")
    assert case_violations(cases).count() == 0
    assert sorted((r.name, r.test_type) for r in runnable_cases(cases).collect()) == [("ok", "simple"), ("repo", "integration")]
    bad = cases.union(spark.createDataFrame([("bad", True, None, False, False)], cases.schema))
    with pytest.raises(ValueError):
        runnable_cases(bad)


def test_extract_examples(spark):
    code = "user = Entity(name='user', join_keys=[Field('id', Int64)], description='A user of the shop')\n"
    files = spark.createDataFrame([("a.py", code, "native"), ("tiny.py", "x = 1", "spark")],
                                  "path string, content string, directory_type string")
    rows = extract_examples(files).collect()
    assert [(r.path, r.text) for r in rows] == [("a.py", "Example of Entity. A user of the shop")]
    calls = []

    def answer(code):
        calls.append(1)
        if "Entity" in code:
            return '{"declarations": [["Entity", "users"], ["only-one"]]}'
        raise RuntimeError("model error")
    files2 = files.union(spark.createDataFrame([("b.py", "# " + "y" * 60, "spark")], files.schema))
    got = sorted((r.path, r.text) for r in extract_examples(files2, json_extractor(answer)).collect())
    assert got == [("a.py", "Example of Entity. users")]
