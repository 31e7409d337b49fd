"""Folders of files to partitioned data sets."""
from tessera.operators.file_sets import DocSet, write_code_examples, write_doc_chunks
from tessera.sources.files import read_partitioned

TEN = "one two three four five six seven eight nine ten"


def test_versions_are_rewritten_alone(spark, tmp_path):
    for v in ("a", "b"):
        (tmp_path / v / "guide").mkdir(parents=True)
        (tmp_path / v / "guide" / "x.md").write_text(f"# {v}\n{TEN}")
        (tmp_path / v / "guide" / "x.mdx").write_text(f"# no\n{TEN}")
        (tmp_path / v / "bad.md").write_bytes(b"# \xff\n" + TEN.encode())
    sets = [DocSet(v, str(tmp_path / v), f"https://{v}/") for v in ("a", "b")]
    out = str(tmp_path / "out")
    assert sorted(r.doc_version for r in write_doc_chunks(spark, sets, out).collect()) == ["a", "b"]
    (tmp_path / "a" / "guide" / "x.md").unlink()
    (tmp_path / "b" / "guide" / "x.md").write_text(f"# new\n{TEN}")
    write_doc_chunks(spark, sets[1:], out)
    got = {(r.doc_version, r.header, r.url) for r in read_partitioned(spark, out, "doc_version").collect()}
    assert got == {("a", "# a", "https://a/guide/x"), ("b", "# new", "https://b/guide/x")}


def test_examples_of_a_users_extractor_keep_repeats(spark, tmp_path):
    (tmp_path / "k").mkdir()
    for n in "xy":
        (tmp_path / "k" / f"{n}.py").write_text("# " + "y" * 60)
    out = str(tmp_path / "out")
    write_code_examples(spark, [(str(tmp_path / "k"), "kind"), (str(tmp_path / "none"), "other")], out,
                        lambda code: [["f", "does"], ["alone"]])
    assert [r.text for r in read_partitioned(spark, out, "directory_type").collect()] == ["Example of f. does"] * 2
