"""Scans, projections, filters, shaping, sets, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.catalog import cents, read, register
from quern.plans.registry import query


@query("""SELECT c_mktsegment, count(DISTINCT o_orderkey)::BIGINT AS n_orders, count(*)::BIGINT AS n_lines,
  sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT))::BIGINT AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue in ten-thousandths by market segment: the flagship query."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    net = cents("l_extendedprice") * (100 - cents("l_discount"))
    per_order = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(net).alias("net"))
    return per_order.join(orders, "l_orderkey").join(customers, "o_custkey").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("n").alias("n_lines"), F.sum("net").alias("revenue")
    )


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")
def scan_filter(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_totalprice > 400000 AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderdate")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) AS net,
  CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS size_class FROM lineitem""")
def project_derive(spark, sf_dir):
    size = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "middle").otherwise("large")
    lines = read(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("net"), size.alias("size_class"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#7') AND p_name LIKE '%ring%' AND p_size BETWEEN 5 AND 30 AND NOT p_type = 'ECONOMY'")
def predicates(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.where(part.p_brand.isin("Brand#1", "Brand#7") & part.p_name.like("%ring%") & part.p_size.between(5, 30) & ~(part.p_type == "ECONOMY")).select("p_partkey", "p_name")


@query("""SELECT c_custkey, big FROM customer, LATERAL (SELECT max(o_totalprice) AS big FROM orders WHERE o_custkey = c_custkey) WHERE c_acctbal > 9000""")
def lateral_subquery(spark, sf_dir):
    register(spark, sf_dir, "customer", "orders")
    return spark.sql("SELECT c_custkey, big FROM customer, LATERAL (SELECT max(o_totalprice) AS big FROM orders WHERE o_custkey = c_custkey) WHERE c_acctbal > 9000")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
def scalar_subquery(spark, sf_dir):
    register(spark, sf_dir, "supplier")
    return spark.sql("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_subquery(spark, sf_dir):
    register(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def exists_subquery(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_semi")


_YEARS = """WITH RECURSIVE years AS (SELECT min(extract(year FROM o_orderdate)) AS y FROM orders
  UNION ALL SELECT y + 1 FROM years WHERE y < (SELECT max(extract(year FROM o_orderdate)) FROM orders))
  SELECT CAST(y AS BIGINT) AS y, count(o_orderkey) AS n FROM years LEFT JOIN orders ON extract(year FROM o_orderdate) = y GROUP BY y"""


@query(_YEARS)
def recursive_cte(spark, sf_dir):
    """Every year from the first order to the last, and its orders."""
    register(spark, sf_dir, "orders")
    return spark.sql(_YEARS)


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderpriority")
def pipe_syntax(spark, sf_dir):
    register(spark, sf_dir, "orders")
    return spark.sql("FROM orders |> WHERE o_orderstatus = 'P' |> AGGREGATE count(*) AS n GROUP BY o_orderpriority")


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F')::BIGINT AS f, count(*) FILTER (l_linestatus = 'O')::BIGINT AS o FROM lineitem GROUP BY l_returnflag""")
def pivot(spark, sf_dir):
    counted = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return counted.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("""SELECT p_partkey, 'size' AS field, p_size::DOUBLE AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""")
def unpivot(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return part.unpivot("p_partkey", ["size", "price"], "field", "amount")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode_words(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT p_partkey, unnest(range(len(string_split(p_name, ' '))))::BIGINT AS pos, unnest(string_split(p_name, ' ')) AS word FROM part")
def posexplode_words(spark, sf_dir):
    found = read(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT s_suppkey, 'name' AS k, s_name AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::VARCHAR FROM supplier")
def stack_columns(spark, sf_dir):
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "stack(2, 'name', s_name, 'nation', CAST(s_nationkey AS STRING)) AS (k, v)")


@query("SELECT c_name AS name, c_acctbal AS has FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name, s_acctbal FROM supplier")
def union_all(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("has"))
    return customers.unionByName(read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("has")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 450000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice < 5000")
def intersect_distinct(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("k")).intersect(orders.where("o_totalprice < 5000").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def except_distinct(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).subtract(read(spark, sf_dir, "lineitem").select("l_orderkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def global_top_k(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def limit_offset(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def full_sort(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey")


@query("SELECT l_returnflag, l_orderkey, l_shipdate, l_extendedprice FROM lineitem WHERE md5(l_orderkey::VARCHAR || ':7') < '1999'")
def sample_by_hash(spark, sf_dir):
    """A repeatable sample of orders with all their lines: the ids whose digest is below a bound."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.where(F.md5(F.concat(F.col("l_orderkey").cast("string"), F.lit(":7"))) < "1999").select("l_returnflag", "l_orderkey", "l_shipdate", "l_extendedprice")


@query()
def sample_percent(spark, sf_dir):
    """TABLESAMPLE with a seed."""
    register(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_orderdate FROM orders TABLESAMPLE (10 PERCENT) REPEATABLE (7)")
