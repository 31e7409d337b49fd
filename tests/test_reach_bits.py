"""Reachability by words of 64 groups, and frequencies whose size a join knows."""
from tessera.operators import graph
from tessera.operators.embed import HashingEmbedder, term_counts


def test_groups_go_as_bits(spark, monkeypatch):
    written, plain = [], graph.materialize

    def counted(df, name):
        out = plain(df, name)
        written.append(out.count() if name == "hop" else 0)
        return out
    monkeypatch.setattr(graph, "materialize", counted)
    seeds = spark.createDataFrame([(g or None, 0) for g in range(50)] + [(7, None), (7, 0)], "g int, n int").coalesce(1)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (None, 2)], "src int, dst int")
    got = sorted(map(tuple, graph.reachable(seeds, edges, "g", "n").collect()), key=str)
    assert got == sorted([(g or None, n) for g in range(50) for n in range(3)] + [(7, None)], key=str)
    assert sum(written) <= 2 * 3 + 1  # a row for each node and word, not for each group


def test_frequencies_are_written(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "id int, text string")
    model = HashingEmbedder(8).fit_terms(term_counts(docs, "id", "text"), "id")
    assert len(model.df.inputFiles()) > 0 and "Aggregate" not in model.df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.tok, r.df) for r in model.df.collect()} == {("a", 1), ("b", 2), ("c", 1)}
