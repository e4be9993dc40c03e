"""Aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.catalog import cents, read
from quern.operators import scans, windows
from quern.plans.registry import query


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS price,
  round(avg(l_discount), 6) AS disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '2000-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.sum(cents("l_extendedprice")).alias("price"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def collected_list(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string"))
    return orders.groupBy("o_custkey").agg(F.array_join(keys, ",").alias("orders"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT l_suppkey)::BIGINT AS suppliers FROM lineitem GROUP BY l_returnflag")
def multi_distinct(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS f, (sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = 'P'))::BIGINT AS p FROM orders GROUP BY o_orderpriority")
def filtered_aggregate(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority").agg(F.count_if(orders.o_orderstatus == "F").alias("f"), F.sum(F.when(orders.o_orderstatus == "P", cents("o_totalprice"))).alias("p"))


_GROUPED = "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::BIGINT AS g1, grouping(o_orderpriority)::BIGINT AS g2, count(*)::BIGINT AS n FROM orders GROUP BY "


def _grouping(df):
    return df.agg(F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"), F.count(F.lit(1)).alias("n"))


@query(_GROUPED + "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return _grouping(orders.groupingSets([[orders.o_orderstatus], [orders.o_orderpriority], []], orders.o_orderstatus, orders.o_orderpriority))


@query(_GROUPED + "CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf_dir):
    return _grouping(read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority"))


@query(_GROUPED + "ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, sf_dir):
    return _grouping(read(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority"))


@query("SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS sd, round(var_pop(p_retailprice), 4) AS var, round(stddev_pop(p_size), 6) AS size_sd FROM part GROUP BY p_brand")
def variance(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"), F.round(F.var_pop("p_retailprice"), 4).alias("var"), F.round(F.stddev_pop("p_size"), 6).alias("size_sd")
    )


@query("SELECT c_mktsegment, round(median(c_acctbal), 4) AS middle, round(quantile_cont(c_acctbal, 0.9), 4) AS top, quantile_disc(c_acctbal, 0.25) AS low FROM customer GROUP BY c_mktsegment")
def percentiles(spark, sf_dir):
    found = windows.quantiles(read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", 100.0, {"middle": 0.5, "top": 0.9}, {"low": 0.25})
    return found.select("c_mktsegment", F.round("middle", 4).alias("middle"), F.round("top", 4).alias("top"), "low")


@query("SELECT s_nationkey, round(median(s_acctbal), 4) AS middle, round(quantile_cont(s_acctbal, 0.9), 4) AS top, quantile_disc(s_acctbal, 0.25) AS low FROM supplier GROUP BY s_nationkey")
def percentile_functions(spark, sf_dir):
    """The built-in exact percentiles, which keep every different value of a group: for small groups."""
    low = F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY s_acctbal)")
    return read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.median("s_acctbal"), 4).alias("middle"), F.round(F.percentile("s_acctbal", 0.9), 4).alias("top"), low.alias("low"))


@query("SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY s_nationkey")
def listagg(spark, sf_dir):
    return read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.expr("listagg(s_name, ',') WITHIN GROUP (ORDER BY s_name)").alias("names"))


@query("SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS richest, arg_min(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY c_nationkey")
def arg_extremes(spark, sf_dir):
    """Of several customers with a nation's highest or lowest balance, the one with the least key: the first in the table. Rows without a key or a balance don't count."""
    both = F.col("c_custkey").isNotNull() & F.col("c_acctbal").isNotNull()
    highest = F.when(both, F.struct("c_acctbal", F.bitwise_not("c_custkey")))
    lowest = F.when(both, F.struct("c_acctbal", "c_custkey"))
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", highest).alias("richest"), F.min_by("c_custkey", lowest).alias("poorest"))


@query("SELECT p_type, round(corr(p_size, p_retailprice), 6) AS r, round(covar_samp(p_size, p_retailprice), 4) AS cov, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS base FROM part GROUP BY p_type")
def regression(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_type").agg(
        F.round(F.corr("p_size", "p_retailprice"), 6).alias("r"), F.round(F.covar_samp("p_size", "p_retailprice"), 4).alias("cov"),
        F.round(F.regr_slope("p_retailprice", "p_size"), 6).alias("slope"), F.round(F.regr_intercept("p_retailprice", "p_size"), 4).alias("base"),
    )


@query("SELECT o_orderstatus, bool_and(o_totalprice > 0) AS all_paid, bool_or(o_totalprice > 499000) AS any_big, bit_xor(o_orderkey)::BIGINT AS x FROM orders GROUP BY o_orderstatus")
def logical_aggregates(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.bool_and(F.col("o_totalprice") > 0).alias("all_paid"), F.bool_or(F.col("o_totalprice") > 499000).alias("any_big"), F.bit_xor("o_orderkey").alias("x")
    )


@query("SELECT event_type, mode(user_id % 3)::BIGINT AS m FROM (SELECT event_type, CASE WHEN user_id < 100 THEN 0 ELSE user_id END AS user_id FROM events) GROUP BY event_type")
def most_common(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("u", F.when(F.col("user_id") < 100, 0).otherwise(F.col("user_id")) % 3)
    return events.groupBy("event_type").agg(F.mode("u").cast("long").alias("m"))


@query("""SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15""")
def having(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 15")


@query("SELECT c_nationkey, any_value(n_name) AS n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey")
def any_of_group(spark, sf_dir):
    """any_value where all values of a group are the same."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = read(spark, sf_dir, "customer").select("c_nationkey").join(nation, "c_nationkey")
    return joined.groupBy("c_nationkey").agg(F.any_value("n_name").alias("n_name"), F.count(F.lit(1)).alias("n"))


@query()
def approximate_counts(spark, sf_dir):
    """Sketches: distinct counts by HyperLogLog, quantiles by Greenwald-Khanna and KLL."""
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("orders"),
        F.percentile_approx("l_extendedprice", [0.5, 0.99], 1000).alias("prices"), F.expr("approx_top_k(l_suppkey, 5)").alias("suppliers"),
    )


@query("""SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER w AS n, ntile(4) OVER w AS q FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def ranking(spark, sf_dir):
    """A customer's orders are sorted within months; numbers of rows and values of the months before are added."""
    names = {"rank": "r", "dense_rank": "d", "row_number": "n", "rows": "all_rows"}
    ranked = scans.ranks(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.trunc("o_orderdate", "month"), names)
    return ranked.select("o_custkey", "o_orderkey", "r", "d", "n", scans.tile(F.col("n"), F.col("all_rows"), 4).alias("q"))


@query("SELECT s_suppkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)")
def relative_ranking(spark, sf_dir):
    ranked = scans.ranks(read(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_acctbal"], F.floor(F.col("s_acctbal") / 500), {"rank": "r", "rows": "n", "up_to": "u"})
    percent = F.when(F.col("n") > 1, (F.col("r") - 1) / (F.col("n") - 1)).otherwise(0.0)
    return ranked.select("s_suppkey", F.round(percent, 9).alias("p"), F.round(F.col("u") / F.col("n"), 9).alias("c"))


@query("""SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS later, first_value(event_type) OVER w AS opened, coalesce(nth_value(event_id, 3) OVER w, -1) AS third
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def offsets(spark, sf_dir):
    """lag and lead look into numbered blocks; the first type and the third id are carried from day to day."""
    rows = read(spark, sf_dir, "events")
    near = scans.near_rows(rows, ["user_id"], ["ts", "event_id"], F.to_date("ts"), 1, 2, lambda w: {"before": F.lag("value").over(w), "later": F.lead("value", 2, -1.0).over(w)})
    numbered = scans.ranks(near, ["user_id"], ["ts", "event_id"], F.to_date("ts"), {"row_number": "row"})
    told = {"opened": ("last", F.when(F.col("row") == 1, F.col("event_type"))), "third": ("last", F.when(F.col("row") == 3, F.col("event_id")))}
    return scans.scan(numbered, ["user_id"], ["ts", "event_id"], F.to_date("ts"), told, peers=False).select("event_id", "before", "later", "opened", F.coalesce("third", F.lit(-1)).alias("third"))


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_click FROM events""")
def last_ignoring_nulls(spark, sf_dir):
    clicked = {"last_click": ("last", F.when(F.col("event_type") == "click", F.col("event_id")))}
    found = scans.scan(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.to_date("ts"), clicked, peers=False)
    return found.select("event_id", F.coalesce("last_click", F.lit(-1)).alias("last_click"))


@query("SELECT event_id, (sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))::BIGINT AS moving FROM events")
def rows_frame(spark, sf_dir):
    found = scans.near_rows(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.to_date("ts"), 4, 0, lambda w: {"moving": F.sum(cents("value")).over(w.rowsBetween(-4, 0))})
    return found.select("event_id", "moving")


@query("SELECT event_id, (count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW))::BIGINT AS recent FROM events")
def range_frame(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return scans.over_range(events, ["event_type"], "micros", 6 * 3_600_000_000, {"recent": ("count", F.lit(1))}).select("event_id", "recent")


@query("SELECT p_partkey, (sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW))::BIGINT AS near_size FROM part")
def groups_frame(spark, sf_dir):
    """A brand's parts are aggregated by type first; the frame runs over a row a type."""
    found = scans.over_groups(read(spark, sf_dir, "part"), ["p_brand"], "p_type", 1, 0, {"near_size": ("sum", F.col("p_size").cast("long"))}, F.substring("p_type", 1, 2))
    return found.select("p_partkey", "near_size")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def qualify(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return windows.qualify(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), F.row_number().over(order), lambda q: q == 1).select("o_orderkey", "o_custkey")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_k_per_group(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return windows.top_per_group(part, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)


@query("""SELECT user_id, session, count(*)::BIGINT AS n, min(event_id) AS first_event FROM (SELECT *, (sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM
  (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOURS THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS opens FROM events))
  GROUP BY user_id, session""")
def sessionize(spark, sf_dir):
    found = scans.sessions(read(spark, sf_dir, "events"), "user_id", "ts", "2 HOURS", F.to_date("ts"))
    return found.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""WITH daily AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*)::BIGINT AS n FROM events GROUP BY 1, 2),
  grid AS (SELECT event_type, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY 1)
  SELECT event_type, strftime(day, '%Y-%m-%d') AS day, last_value(n IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day) AS n FROM grid LEFT JOIN daily USING (event_type, day)""")
def fill_gaps(spark, sf_dir):
    daily = read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return windows.gaps_filled(daily, "event_type", "day", "DAY", "n").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
