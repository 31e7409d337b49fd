"""Partitions of shuffles follow the rows, so that a task's share does not grow."""
import duckdb
import pytest
from oracle_util import compare
from pyspark.sql import functions as F

import tessera.plans  # noqa: F401  (registers the queries)
from tessera.plans import features
from tessera.plans.registry import ORACLE, QUERIES
from tessera.session import shuffles_of


def test_shuffles_follow_the_rows(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with shuffles_of(spark, 100, 1000):
        assert spark.conf.get(key) == before
    with pytest.raises(RuntimeError), shuffles_of(spark, 50_000, 1000):
        assert spark.conf.get(key) == "50"
        assert spark.range(1000).groupBy(F.col("id") % 97).count().rdd.getNumPartitions() == 50
        raise RuntimeError
    assert spark.conf.get(key) == before


def test_sql_feature_deals_rows_to_enough_tasks(spark, tmpdir_path, monkeypatch):
    con = duckdb.connect()
    for name, sql in {
        "nation": "SELECT i::INT AS n_nationkey, 'N' || i AS n_name FROM range(3) r(i)",
        "customer": "SELECT i AS c_custkey, (i % 4)::INT AS c_nationkey, 'M' || i % 2 AS c_mktsegment FROM range(40) r(i)",
        "orders": "SELECT i AS o_orderkey, CASE WHEN i % 3 > 0 THEN i % 50 ELSE 7 END AS o_custkey FROM range(300) r(i)",
        "lineitem": """SELECT i % 310 AS l_orderkey, i % 17 AS l_partkey, (i % 1000)::DOUBLE AS l_extendedprice,
                       (i % 10) / 100.0::DOUBLE AS l_discount FROM range(1200) r(i)"""}.items():
        con.execute(f"COPY ({sql}) TO '{tmpdir_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmpdir_path}/{name}.parquet')")
    monkeypatch.setattr(features, "SQL_ROWS_PER_TASK", 60)
    seen, write = [], features.materialize

    def kept(df, name):
        seen.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return write(df, name)

    monkeypatch.setattr(features, "materialize", kept)
    ok, info = compare(QUERIES["sql_feature"](spark, tmpdir_path), con, ORACLE["sql_feature"])
    assert ok, info
    assert seen == [25]
