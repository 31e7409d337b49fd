"""The driver calls entry()/queries() from its own session and directory:
UDF-backed operators must not depend on the package being importable by
the Python workers."""
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as E
print("ROWS", E.entry(spark).count(), E.queries()["knn_mmr"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 5000 5000" in out.stdout, out.stderr[-2000:]
