"""The join family."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import cents, read, register
from quern.operators import joins
from quern.plans.registry import query


@query("SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def broadcast_join(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup_join(read(spark, sf_dir, "customer").select("c_nationkey"), nation, "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, l_partkey, l_quantity, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def sort_merge_join(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.hint("merge").join(orders, lines.l_orderkey == orders.o_orderkey).select("o_orderkey", "l_partkey", "l_quantity", "o_orderdate")


@query("SELECT p_brand, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def shuffled_hash_join(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return lines.join(part.hint("shuffle_hash"), "l_partkey").groupBy("p_brand").agg(F.sum("q").alias("qty"))


@query("SELECT o_orderkey, count(l_orderkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def left_outer_join(spark, sf_dir):
    counted = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(counted, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT coalesce(l_orderkey, -1) AS l_orderkey, p_partkey, p_name FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity = 1) RIGHT JOIN part ON l_partkey = p_partkey")
def right_outer_join(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_quantity = 1").select("l_orderkey", "l_partkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = lines.join(part, lines.l_partkey == part.p_partkey, "right")
    return joined.select(F.coalesce("l_orderkey", F.lit(-1)).alias("l_orderkey"), "p_partkey", "p_name")


@query("""SELECT coalesce(c.k, s.k) AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) c
  FULL JOIN (SELECT s_nationkey AS k, count(*)::BIGINT AS n FROM supplier GROUP BY 1) s ON c.k = s.k""")
def full_outer_join(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    suppliers = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return customers.join(suppliers, "k", "full")


@query("SELECT r_name, c_mktsegment, n FROM region, (SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY c_mktsegment)")
def cross_join(spark, sf_dir):
    """Of two sides that stay small: regions, and a row a market segment."""
    counted = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return read(spark, sf_dir, "region").select("r_name").crossJoin(counted)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)")
def left_semi_join(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def left_anti_join(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey ELSE 0 END FROM nation)")
def not_in_join(spark, sf_dir):
    register(spark, sf_dir, "part", "nation")
    return spark.sql("SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey ELSE 0 END FROM nation)")


@query("""SELECT c_custkey, count(s_suppkey)::BIGINT AS n FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal GROUP BY c_custkey""")
def theta_join(spark, sf_dir):
    """An inequality beside an equi-key: how many suppliers of their nation each customer's balance exceeds."""
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_custkey")
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_acctbal")
    return joins.count_below(c, s, "c_nationkey", "c_acctbal", "s_acctbal", 100.0).select("c_custkey", "n")


@query("SELECT s_suppkey, p_partkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 2 AND s_acctbal + 2")
def band_join(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    bands = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 2).alias("low"), (F.col("s_acctbal") + 2).alias("high"))
    return joins.band_join(part, bands, "p_retailprice", "low", "high", 4.0).select("s_suppkey", "p_partkey")


@query("""SELECT p.event_id AS purchase_id, c.event_id AS click_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts > p.ts AND c.ts <= p.ts + INTERVAL 2 HOURS
  WHERE p.event_type = 'purchase' AND c.event_type = 'click'""")
def interval_join(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase_id"))
    clicked = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("clicked_at"), F.col("event_id").alias("click_id"))
    return joins.interval_pairs(bought, clicked, "user_id", "at", "2 HOURS", "clicked_at").select("purchase_id", "click_id")


@query("""SELECT p.event_id, p.user_id, coalesce(c.event_id, -1) AS click_id, c.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_join(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicked = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return joins.asof_join(bought, clicked, ["user_id"], "ts", ["click_id", "click_value"], cell=F.to_date).select(
        "event_id", "user_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"), "click_value"
    )


@query("SELECT o_orderstatus, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def salted_join(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("q"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return joins.salted_join(lines, orders, "k").groupBy("o_orderstatus").agg(F.sum("q").alias("qty"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 500")
def self_join(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier")
    a = supplier.select(F.col("s_suppkey").alias("a"), "s_nationkey", F.col("s_acctbal").alias("has"))
    b = supplier.select(F.col("s_suppkey").alias("b"), "s_nationkey", F.col("s_acctbal").alias("other"))
    return a.join(b, "s_nationkey").where("a < b AND abs(has - other) < 500").select("a", "b")


@query("""SELECT r_name, sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT))::BIGINT AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def star_join(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("net"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("c_nationkey"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    joined = lines.join(orders, "l_orderkey").join(customer, "c_custkey").join(supplier, ["l_suppkey", "c_nationkey"]).join(nation, "c_nationkey")
    return joined.join(read(spark, sf_dir, "region"), "r_regionkey").groupBy("r_name").agg(F.sum("net").alias("revenue"))
