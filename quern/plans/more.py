"""Further forms: collations, sketches, subqueries as DataFrames, Arrow functions, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from quern.catalog import cents, read, register
from quern.functions.sketches import count_min_estimate, count_min_total
from quern.operators import joins, scans, similar_sets
from quern.plans.registry import query
from quern.sources import files
from quern.streaming import events


@query("SELECT lower(p_name) AS name, count(*)::BIGINT AS n FROM part GROUP BY lower(p_name)")
def collated_groups(spark, sf_dir):
    """Upper- and lower-case spellings fall together under a collation."""
    part = read(spark, sf_dir, "part")
    spelled = F.when(part.p_partkey % 2 == 0, F.upper("p_name")).otherwise(part.p_name)
    grouped = part.select(F.collate(spelled, "UTF8_LCASE").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.collate(F.lower("name"), "UTF8_BINARY").alias("name"), "n")


@query()
def sound_keys(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.soundex("p_name").alias("sound")).agg(F.count(F.lit(1)).alias("n"))


@query()
def sketches(spark, sf_dir):
    """KLL quantiles and theta set sizes, merged per flag from partial sketches."""
    register(spark, sf_dir, "lineitem")
    return spark.sql("""SELECT l_returnflag, kll_sketch_get_quantile_double(kll_sketch_agg_double(l_extendedprice), 0.5) AS middle,
      theta_sketch_estimate(theta_sketch_agg(l_orderkey)) AS orders FROM lineitem GROUP BY l_returnflag""")


@query()
def count_min(spark, sf_dir):
    """Count-min sketches of a column for each flag, merged from partial ones."""
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_min_sketch("l_suppkey", F.lit(0.001), F.lit(0.99), F.lit(42)).alias("sketch"))


@query("SELECT l_returnflag, l_suppkey, count(*)::BIGINT AS n, true AS not_below, true AS near FROM lineitem GROUP BY l_returnflag, l_suppkey")
def count_min_points(spark, sf_dir):
    """What each flag's sketch says of each supplier, beside the exact count: never below it, and above by a thousandth of the total at most."""
    lines = read(spark, sf_dir, "lineitem")
    sketched = lines.groupBy("l_returnflag").agg(F.count_min_sketch("l_suppkey", F.lit(0.001), F.lit(0.99), F.lit(42)).alias("sketch"))
    exact = lines.groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    told = joins.lookup_join(exact, sketched, "l_returnflag").withColumns({"told": count_min_estimate(F.col("sketch"), F.col("l_suppkey"), 7), "total": count_min_total(F.col("sketch"))})
    return told.select("l_returnflag", "l_suppkey", "n", (F.col("told") >= F.col("n")).alias("not_below"), (F.col("told") <= F.col("n") + 0.001 * F.col("total")).alias("near"))


@query("SELECT l_returnflag, count(*)::BIGINT AS n, true AS parts_near, true AS orders_near, true AS middle_near, true AS top_counts FROM lineitem GROUP BY l_returnflag")
def sketch_merge(spark, sf_dir):
    """Sketches of each flag and month are stored, and merged by flag from the files; the answers lie within their bounds of the exact ones."""
    lines = read(spark, sf_dir, "lineitem").withColumn("month", F.trunc("l_shipdate", "month").cast("string"))
    stored = files.round_trip(lines.groupBy("l_returnflag", "month").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("l_partkey").alias("parts"), F.expr("theta_sketch_agg(l_orderkey)").alias("orders"),
        F.expr("kll_sketch_agg_double(l_extendedprice)").alias("prices"), F.expr("approx_top_k_accumulate(l_linenumber, 1000)").alias("numbers"),
    ), "parquet")
    merged = stored.groupBy("l_returnflag").agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("parts")).alias("parts"), F.expr("theta_sketch_estimate(theta_union_agg(orders))").alias("orders"),
        F.expr("kll_sketch_get_quantile_double(kll_merge_agg_double(prices), 0.5D)").alias("middle"), F.expr("approx_top_k_estimate(approx_top_k_combine(numbers, 1000), 1)[0]").alias("top"),
    )
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact_parts"), F.count_distinct("l_orderkey").alias("exact_orders"))
    below = joins.lookup_join(lines, merged.select("l_returnflag", "middle"), "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= F.col("middle")).cast("double")).alias("share"))
    most = lines.groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("k")).groupBy("l_returnflag").agg(F.max("k").alias("most"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.08 * F.col(b)
    both = merged.join(exact, "l_returnflag").join(below, "l_returnflag").join(most, "l_returnflag")
    return both.select("l_returnflag", "n", near("parts", "exact_parts").alias("parts_near"), near("orders", "exact_orders").alias("orders_near"),
        (F.abs(F.col("share") - 0.5) <= 0.03).alias("middle_near"), (F.col("top.count") == F.col("most")).alias("top_counts"))


@query("""WITH sets AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS s FROM lineitem GROUP BY l_orderkey),
  items AS (SELECT l_orderkey AS k, len(s) AS n, unnest(s) AS x FROM sets),
  pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS every FROM items a JOIN items b ON a.x = b.x AND b.k < a.k GROUP BY a.k, b.k)
  SELECT l_orderkey, coalesce(first, l_orderkey) AS first FROM sets LEFT JOIN (SELECT a AS l_orderkey, min(b) AS first FROM pairs WHERE shared / every >= 0.75 GROUP BY a) USING (l_orderkey)""")
def similar_baskets(spark, sf_dir):
    """For each order the first one whose suppliers are nearly the same, by minima of hashes."""
    baskets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("suppliers"))
    return similar_sets.first_alike(baskets, "l_orderkey", "suppliers").select("l_orderkey", "first")


@query()
def sample_fraction(spark, sf_dir):
    return read(spark, sf_dir, "events").sample(fraction=0.2, seed=7).select("event_id", "user_id")


@query("SELECT s_suppkey, 'balance' AS what, s_acctbal AS x FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def inline_structs(spark, sf_dir):
    pair = lambda what, x: F.struct(F.lit(what).alias("what"), F.col(x).cast("double").alias("x"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.inline(F.array(pair("balance", "s_acctbal"), pair("nation", "s_nationkey"))))


@query("SELECT p_partkey, unnest(range(0, p_size % 3))::BIGINT AS i FROM part")
def arrow_table_function(spark, sf_dir):
    """An Arrow table function takes a table, a batch at a time."""

    @F.arrow_udtf(returnType="p_partkey long, i long")
    class CountArrow:
        def eval(self, rows: pa.RecordBatch):
            n = rows.column("n").to_numpy(zero_copy_only=False)
            first = np.repeat(np.cumsum(n) - n, n)
            yield pa.table({"p_partkey": np.repeat(rows.column("p_partkey").to_numpy(), n), "i": np.arange(n.sum()) - first})

    spark.udtf.register("quern_count_arrow", CountArrow)
    register(spark, sf_dir, "part")
    return spark.sql("SELECT p_partkey, i FROM quern_count_arrow(TABLE(SELECT p_partkey, p_size % 3 AS n FROM part))")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier) AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < 0)")
def subqueries_as_frames(spark, sf_dir):
    supplier, customer = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    average = supplier.select(F.avg("s_acctbal")).scalar()
    in_debt = customer.where((F.col("c_nationkey") == F.col("s_nationkey").outer()) & (F.col("c_acctbal") < 0)).exists()
    return supplier.where((F.col("s_acctbal") > average) & in_debt).select("s_suppkey", "s_acctbal")


@query("SELECT n_nationkey, i.n AS customers FROM nation, LATERAL (SELECT count(*)::BIGINT AS n FROM customer WHERE c_nationkey = n_nationkey) i")
def lateral_join(spark, sf_dir):
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    counted = customer.where(F.col("c_nationkey") == F.col("n_nationkey").outer()).select(F.count(F.lit(1)).alias("customers"))
    return nation.lateralJoin(counted).select("n_nationkey", "customers")


@query("SELECT p_partkey, upper(p_brand) || '!' AS shout FROM part")
def arrow_scalar(spark, sf_dir):
    @F.arrow_udf("string")
    def shout(names: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise(pc.utf8_upper(names), "!", "")

    return read(spark, sf_dir, "part").select("p_partkey", shout("p_brand").alias("shout"))


@query("SELECT user_id, event_id, (sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT AS so_far FROM events")
def running_sum(spark, sf_dir):
    found = scans.scan(read(spark, sf_dir, "events"), ["user_id"], ["ts"], F.to_date("ts"), {"so_far": ("sum", cents("value"))})
    return found.select("user_id", "event_id", "so_far")


@query("SELECT event_id, props FROM events WHERE value > 60")
def map_in_pandas(spark, sf_dir):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.loc[rows["value"] > 60, ["event_id", "props"]]

    return read(spark, sf_dir, "events").select("event_id", "props", "value").mapInPandas(keep, "event_id long, props string")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events
  WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES GROUP BY ALL""")
def stream_append(spark, sf_dir):
    """In append mode a window comes out once the watermark has passed its end."""
    stream = events.read_stream(spark, f"{sf_dir}/events.parquet", read(spark, sf_dir, "events").schema)
    return events.drain(events.tumbling(stream, "1 hour", "10 minutes"))


@query("""SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type""")
def stream_memory(spark, sf_dir):
    """A memory sink keeps its rows on the driver: here a row an event type."""
    stream = events.read_stream(spark, f"{sf_dir}/events.parquet", read(spark, sf_dir, "events").schema)
    return events.to_memory(stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")


@query("""WITH opened AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events),
  numbered AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM opened)
  SELECT user_id, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*)::BIGINT AS n FROM numbered GROUP BY user_id, s
  HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def stream_timers(spark, sf_dir):
    """Keyed state with event-time timers: sessions that the watermark has closed."""
    stream = events.read_stream(spark, f"{sf_dir}/events.parquet", read(spark, sf_dir, "events").schema)
    return events.drain(events.closed_sessions(stream, "1 HOUR", "10 minutes"), settings=events.ROCKSDB)


@query("SELECT e.event_id, e.user_id, r.n AS events_of_user FROM events e JOIN (SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id) r USING (user_id) WHERE e.event_type = 'purchase'")
def stream_static_join(spark, sf_dir):
    """A stream joined with a table."""
    rows = read(spark, sf_dir, "events")
    per_user = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("events_of_user"))
    stream = events.read_stream(spark, f"{sf_dir}/events.parquet", rows.schema).where("event_type = 'purchase'")
    return events.drain(stream.join(per_user, "user_id").select("event_id", "user_id", "events_of_user"))
