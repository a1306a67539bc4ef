"""Queries over databases, on a master whose executors are processes of their own."""

import os
import subprocess
import sys

import pytest

SCRIPT = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
name, small, folder = sys.argv[1:]
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", folder)
         .config("spark.local.dir", folder).config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate())
df = entry.queries()[name](spark, small)
t = spark.read.parquet(f"{small}/supplier.parquet").selectExpr("s_suppkey", "s_name", "s_nationkey", "round(s_acctbal, 2) as s_acctbal")
assert df.dtypes == t.dtypes, df.dtypes
got, want = (sorted(map(tuple, x.collect())) for x in (df, t))
assert got == want and got
spark.stop()
"""


@pytest.mark.parametrize("name", ["jdbc_append", "jdbc_range_scan"])
def test_database_reached_by_several_processes(name, small, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": root}
    run = subprocess.run([sys.executable, "-c", SCRIPT, name, small, str(tmp_path)], cwd=root, env=env, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
