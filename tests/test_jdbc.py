"""Reading and writing other databases."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quern.sources import jdbc


@pytest.fixture(scope="module")
def url(spark):
    return jdbc.local_database(spark)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_and_pushed_filters(spark, url):
    rows = spark.range(1, 101).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("n"), "id").alias("name"))
    jdbc.write(rows, url, "numbers", jdbc.DERBY, types={"name": "VARCHAR(16)"})
    found = jdbc.read(spark, url, "numbers", jdbc.DERBY, "id", connections=4)
    assert found.rdd.getNumPartitions() == 4 and [len(p) for p in found.rdd.glom().collect()] == [25] * 4
    few = found.where("id > 50 AND name = 'n70'").select("x")
    assert "GreaterThan(id,50)" in plan_of(few) and "EqualTo(name,n70)" in plan_of(few) and "ReadSchema: struct<x:double>" in plan_of(few)
    assert [r["x"] for r in few.collect()] == [0.0]


def test_odd_tables(spark, url):
    """Nulls, also in the key, one row, no row, quotation marks in names, time without a zone; appending adds rows."""
    schema = 'k long, "a b" string, t timestamp_ntz'.replace('"', "`")
    rows = [(None, "x", None), (5, None, dt.datetime(2024, 1, 1, 12)), (-3, "", dt.datetime(1999, 1, 1)), (9, "é'\"", None)]
    df = spark.createDataFrame(rows, schema)
    jdbc.write(df, url, "odd", jdbc.DERBY)
    back = jdbc.read(spark, url, "odd", jdbc.DERBY, "k", connections=3)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    jdbc.write(df.limit(1), url, "odd", jdbc.DERBY, mode="append")
    assert jdbc.ask(spark, url, "SELECT count(*) AS n FROM odd", jdbc.DERBY).first()[0] == 5
    for n in (0, 1):
        jdbc.write(spark.range(n), url, "few", jdbc.DERBY)
        assert jdbc.read(spark, url, "few", jdbc.DERBY, "id").count() == n
    assert jdbc.read(spark, url, "few", jdbc.DERBY).count() == 1 and jdbc.quoted('a"b') == '"a""b"'


def test_shards(spark):
    """Odd rows come back from databases that tasks loaded; filters and columns go to all; databases without rows have the columns."""
    schema = "k long, `a b` string, t timestamp_ntz, x double, ok boolean, d date"
    rows = [(None, "x", None, 0.1, True, None), (5, None, dt.datetime(2024, 1, 1, 12, 0, 0, 1), -1e300, None, dt.date(1999, 1, 1)), (-3, "", dt.datetime(1999, 1, 1), None, False, None), (9, "é'\",\n,x", None, 1 / 3, True, None)]
    df = spark.createDataFrame(rows, schema)
    urls = jdbc.write_shards(df, "odd", 3, types={"a b": "VARCHAR(64)"})
    back = jdbc.read_shards(spark, urls, "odd", jdbc.DERBY, "k")
    assert len(urls) == 3 and back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    few = back.where("k > 4").select("x")
    assert plan_of(few).count("GreaterThan(k,4)") >= 3 and plan_of(few).count("ReadSchema: struct<x:double>") == 3
    assert sum(r["n"] for r in jdbc.ask_shards(spark, urls, 'SELECT count(*) AS "n" FROM odd', jdbc.DERBY).collect()) == 4
    empty = jdbc.read_shards(spark, jdbc.write_shards(df.limit(0), "vacant", 2), "vacant", jdbc.DERBY, "k")
    assert empty.count() == 0 and empty.columns == df.columns
    with pytest.raises(ValueError):
        jdbc.write_shards(spark.range(1).selectExpr("array(id) AS a"), "bad")


def test_on_a_cluster(sf, tmp_path):
    """The registered queries on executors that are other processes than the driver, as on a cluster."""
    code = f"""
from pyspark.sql import SparkSession
from quern.plans import databases
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print([q(spark, "{sf}").count() for q in (databases.jdbc_round_trip, databases.jdbc_filtered, databases.jdbc_pushed_aggregate)])
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"SPARK_WORKER_DIR": f"{tmp_path}/worker", "SPARK_LOCAL_DIRS": f"{tmp_path}/local"}
    told = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "[1500, 5, 3]" in told.stdout, told.stderr[-2000:]
