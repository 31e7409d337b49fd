"""Faults found in review: composite keys, deep graphs, folders, ties."""
import datetime as dt

import pytest

from tessera.operators.features import WindowAgg
from tessera.operators.graph import topo_levels
from tessera.operators.views import FeatureService, FeatureView
from tessera.sources.index_store import upsert_index


def test_two_key_view_online_training_and_service(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, "a", t, 1.0), (2, 1, "b", t, 2.0), (3, 1, "a", t + dt.timedelta(hours=1), 3.0)],
                               "event_id long, u long, m string, ts timestamp, v double")
    view = FeatureView("w", ["u", "m"], "ts", ttl_seconds=10 * 86400)
    assert sorted((r.u, r.m, r.v) for r in view.online(df, ["v"], "event_id").collect()) == [(1, "a", 3.0), (1, "b", 2.0)]
    spine = spark.createDataFrame([(1, "a", t + dt.timedelta(minutes=5)), (1, "b", t + dt.timedelta(days=1)),
                                   (2, "a", t + dt.timedelta(days=1))], "u long, m string, ts timestamp")
    got = view.training_rows(spine, df, ["v"], "event_id")
    assert sorted((r.u, r.m, r.v) for r in got.collect()) == [(1, "a", 1.0), (1, "b", 2.0), (2, "a", None)]
    service = FeatureService("s", [(view, df, ["v"])], {"w": {"u": "user"}})
    rows = service.lookup(spine.selectExpr("u as user", "m")).collect()
    assert sorted((r.user, r.m, r["w__v"]) for r in rows) == [(1, "a", 3.0), (1, "b", 2.0), (2, "a", None)]


def test_materialize_reads_what_its_windows_need(spark, tmpdir_path):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, 1, t + dt.timedelta(hours=6 * i), 1.0) for i in range(40)],
                               "event_id long, u long, ts timestamp, v double")
    view = FeatureView("w", ["u"], "ts", aggregations=[WindowAgg("s", "sum", "v", 86400)])
    view.materialize(df, tmpdir_path + "/out", "2024-01-05", "2024-01-06")
    got = spark.read.parquet(tmpdir_path + "/out")
    whole = {r.event_id: r.s for r in view.features(df).collect()}
    assert {r.event_id: r.s for r in got.collect()} == {i: whole[i] for i in range(16, 20)}


def test_levels_of_a_deep_chain_and_a_cycle(spark):
    n = 70
    nodes = spark.createDataFrame([(i,) for i in range(n + 1)], "node long")
    chain = [(i, i + 1) for i in range(n)]
    got = {r.node: r.level for r in topo_levels(nodes, spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {i: n - i for i in range(n + 1)}
    with pytest.raises(RuntimeError, match="cycle"):
        topo_levels(nodes, spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long"))


def test_upsert_of_two_new_rows_with_one_id_is_fixed(spark):
    old = spark.createDataFrame([("x", "old")], "id string, text string")
    new = spark.createDataFrame([("x", "a"), ("x", "b")], "id string, text string")
    one = upsert_index(old, new).collect()
    assert one == upsert_index(old, new.orderBy("text", ascending=False)).collect() and one[0].text in "ab"


def test_a_cluster_without_a_shared_folder_is_an_error():
    from tessera import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
