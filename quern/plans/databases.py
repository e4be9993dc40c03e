"""Tables of other databases, here embedded ones of the kind that Spark's jars hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.catalog import cents, read
from quern.plans.registry import query
from quern.sources import jdbc


def _orders(spark: SparkSession, sf_dir: str) -> list[str]:
    """The addresses of new databases that hold the table orders between them."""
    return jdbc.write_shards(read(spark, sf_dir, "orders"), "orders", types={"o_orderstatus": "VARCHAR(8)", "o_orderpriority": "VARCHAR(32)"})


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def jdbc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to several databases and read from each in ranges of the key between bounds that it is asked for."""
    rows = jdbc.read_shards(spark, _orders(spark, sf_dir), "orders", jdbc.DERBY, "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("""SELECT o_orderpriority, count(*)::BIGINT AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders
  WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY o_orderpriority""")
def jdbc_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters, and the three columns that are used, go to the other databases."""
    rows = jdbc.read_shards(spark, _orders(spark, sf_dir), "orders", jdbc.DERBY, "o_orderkey").where("o_totalprice > 100000 AND o_orderstatus = 'F'")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("cents"))


@query("SELECT o_orderstatus, count(*)::BIGINT AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY o_orderstatus")
def jdbc_pushed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the other databases aggregates, and hands over a row a group."""
    sql = 'SELECT "o_orderstatus", count(*) AS "n", min("o_orderkey") AS "first_key", max("o_orderkey") AS "last_key" FROM orders GROUP BY "o_orderstatus"'
    found = jdbc.ask_shards(spark, _orders(spark, sf_dir), sql, jdbc.DERBY).groupBy("o_orderstatus")
    return found.agg(F.sum("n").cast("long").alias("n"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
