"""Round trips through file formats, and streams compared with the same aggregate over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.catalog import read
from quern.plans.registry import query
from quern.sources import files
from quern.streaming import events

_ORDERS = "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(_ORDERS)
def parquet_round_trip(spark, sf_dir):
    return files.round_trip(_orders(spark, sf_dir), "parquet", ["o_orderpriority"])


@query(_ORDERS)
def orc_round_trip(spark, sf_dir):
    return files.round_trip(_orders(spark, sf_dir), "orc")


@query(_ORDERS)
def csv_round_trip(spark, sf_dir):
    return files.round_trip(_orders(spark, sf_dir), "csv")


@query(_ORDERS)
def json_round_trip(spark, sf_dir):
    return files.round_trip(_orders(spark, sf_dir), "json")


@query("SELECT p_partkey, p_name FROM part")
def xml_round_trip(spark, sf_dir):
    return files.round_trip(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "xml")


@query("SELECT c_name AS value FROM customer")
def text_round_trip(spark, sf_dir):
    return files.round_trip(read(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), "text")


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def partition_pruning(spark, sf_dir):
    """Written by partition; the filter reads one folder."""
    lines = files.round_trip(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), "parquet", ["l_returnflag"])
    return lines.where("l_returnflag = 'R'").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def _events(spark, sf_dir) -> DataFrame:
    return events.read_stream(spark, f"{sf_dir}/events.parquet", read(spark, sf_dir, "events").schema)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL""")
def stream_tumbling(spark, sf_dir):
    return events.drain(events.tumbling(_events(spark, sf_dir), "1 hour", "10 minutes"), "complete")


@query("""SELECT start, count(*)::BIGINT AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS start FROM events) GROUP BY start""")
def stream_sliding(spark, sf_dir):
    return events.drain(events.sliding(_events(spark, sf_dir), "1 hour", "30 minutes", "10 minutes"), "complete")


@query("""SELECT user_id, start, count(*)::BIGINT AS n FROM (SELECT user_id, first_value(ts) OVER (PARTITION BY user_id, s ORDER BY ts) AS start FROM
  (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events)))
  GROUP BY user_id, start""")
def stream_sessions(spark, sf_dir):
    return events.drain(events.session(_events(spark, sf_dir), "1 hour", "10 minutes"), "complete")


@query("SELECT user_id, count(*)::BIGINT AS n, max(round(value * 100)::BIGINT)::BIGINT AS top_cents FROM events GROUP BY user_id")
def stream_state(spark, sf_dir):
    return events.drain(events.running_totals(_events(spark, sf_dir)), "update", ["user_id"])


@query("SELECT count(DISTINCT event_id)::BIGINT AS n FROM events")
def stream_dedupe(spark, sf_dir):
    """The stream put under itself; each event counts once."""
    twice = _events(spark, sf_dir).select("event_id", "ts").union(_events(spark, sf_dir).select("event_id", "ts"))
    return events.drain(events.once_each(twice, ["event_id"], "10 minutes")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM events GROUP BY 1")
def batch_window(spark, sf_dir):
    windowed = read(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"))
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
