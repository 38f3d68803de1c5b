"""An embedded database read by other processes than the one that filled it; values that a sample holds more than once."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_jdbc_scan_on_several_executors(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as e
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
got = e.queries()["jdbc_scan"](spark, "{SF}")
s = spark.read.parquet("{SF}/supplier.parquet").where("s_acctbal > 1000").select("s_suppkey", "s_acctbal")
assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, s.collect()))
print("equal")
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=180)
    assert "equal" in out.stdout, out.stderr[-2000:]


def test_embedded_rows_come_back_whole(spark):
    from tessella.sources import store

    rows = [(1, 0.1, 'a "quoted", text'), (2, None, None), (3, -1e-300, ""), (None, 1e300, "two\nlines")]
    df = spark.createDataFrame(rows, "k bigint, x double, t string").repartition(3)
    url = store.embedded(df, "R")
    assert sorted(map(tuple, store.query(spark, "SELECT * FROM R", url, user="APP", password="APP").collect()), key=repr) == sorted(rows, key=repr)


def test_inverse_percentile_of_repeated_values(spark):
    from tessella.operators import panel as P

    values = [float(v) for v in (10, 20, 20, 20, 20, 20, 20, 40, 40, 40, 40, 40, 40, 50)]
    sample = spark.createDataFrame([(m, v) for m in range(8) for v in values], "month_idx int, me double").repartition(4)
    asked = spark.createDataFrame([(m, x) for m in range(8) for x in (5.0, 10.0, 15.0, 20.0, 30.0, 40.0, 45.0, 60.0)], "month_idx int, me double")
    below = {10: 1, 15: 1.5, 20: 7, 30: 7.5, 40: 13, 45: 13.5}
    for r in P.inverse_percentile(sample, asked, "me").collect():
        want = 0 if r.me < 10 else 100 if r.me > 50 else below[r.me] / 15 * 100
        assert r.percentile == pytest.approx(want), r
