"""Windows by cells against Spark's own, at cells of one value, of three and of all."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from quern.operators import scans, windows

QUIET = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
SOME = st.one_of(st.none(), st.integers(0, 8))
ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 1)), SOME, SOME), max_size=25)
WIDTHS = pytest.mark.parametrize("width", [1, 3, 100])


def frame(spark, rows):
    return spark.createDataFrame([(k, t, v, i) for i, (k, t, v) in enumerate(rows)], "k int, t int, v int, id int")


def same(found, told, columns):
    pick = lambda df: sorted((r["id"], *(r[c] for c in columns)) for r in df.collect())
    key = lambda r: repr(r)
    assert sorted(pick(found), key=key) == sorted(pick(told), key=key)


@WIDTHS
@QUIET
@given(ROWS)
def test_scan(spark, width, rows):
    df, cell = frame(spark, rows), F.floor(F.col("t") / width)
    values = {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}
    peers = Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    told = df.select("id", F.sum("v").over(peers).alias("s"), F.count("v").over(peers).alias("c"), F.min("v").over(peers).alias("low"), F.max("v").over(peers).alias("high"))
    same(scans.scan(df, ["k"], ["t"], cell, values), told, values)
    each = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    told = df.select("id", F.last("v", ignorenulls=True).over(each).alias("l"), F.sum("v").over(each).alias("s"))
    same(scans.scan(df, ["k"], ["t", "id"], cell, {"l": ("last", F.col("v")), "s": ("sum", F.col("v"))}, peers=False), told, ["l", "s"])


@WIDTHS
@QUIET
@given(ROWS)
def test_ranks(spark, width, rows):
    df, cell = frame(spark, rows), F.floor(F.col("t") / width)
    w, each = Window.partitionBy("k").orderBy("t"), Window.partitionBy("k").orderBy("t", "id")
    told = df.select("id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.round(F.percent_rank().over(w), 9).alias("p"), F.round(F.cume_dist().over(w), 9).alias("c"))
    found = scans.ranks(df, ["k"], ["t"], cell, {"rank": "r", "dense_rank": "d", "rows": "n", "up_to": "u"})
    found = found.withColumns({"p": F.round(F.when(F.col("n") > 1, (F.col("r") - 1) / (F.col("n") - 1)).otherwise(0.0), 9), "c": F.round(F.col("u") / F.col("n"), 9)})
    same(found, told, ["r", "d", "p", "c"])
    told = df.select("id", F.row_number().over(each).alias("n"), F.ntile(4).over(each).alias("q"))
    found = scans.ranks(df, ["k"], ["t", "id"], cell, {"row_number": "n", "rows": "all"}).withColumn("q", scans.tile(F.col("n"), F.col("all"), 4))
    same(found, told, ["n", "q"])


@WIDTHS
@QUIET
@given(ROWS)
def test_near_rows(spark, width, rows):
    df, cell = frame(spark, rows), F.floor(F.col("t") / width)
    values = lambda w: {"s": F.sum("v").over(w.rowsBetween(-2, 1)), "b": F.lag("v", 2).over(w), "a": F.lead("v", 1, -1).over(w)}
    told = df.withColumns(values(Window.partitionBy("k").orderBy("t", "id")))
    same(scans.near_rows(df, ["k"], ["t", "id"], cell, 2, 1, values, block=2 + width), told, ["s", "b", "a"])


@WIDTHS
@QUIET
@given(ROWS)
def test_over_groups(spark, width, rows):
    df, cell = frame(spark, rows), F.floor(F.col("t") / width)
    told = windows.over_groups(df, F.sum("v"), ["k"], "t", 1, 2, "s")
    same(scans.over_groups(df, ["k"], "t", 1, 2, {"s": ("sum", F.col("v"))}, cell), told, ["s"])


@WIDTHS
@QUIET
@given(ROWS)
def test_sessions(spark, width, rows):
    df = frame(spark, [r for r in rows if r[1] is not None]).withColumn("ts", F.timestamp_seconds(F.col("t") * 3600))
    told = windows.sessions(df, "k", "ts", "2 HOURS")
    same(scans.sessions(df, "k", "ts", "2 HOURS", F.floor(F.col("t") / width)), told, ["session"])


def test_sessions_without_time(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 0), (1, 9)], "k int, t int").withColumn("ts", F.timestamp_seconds(F.col("t") * 3600))
    found = scans.sessions(df, "k", "ts", "2 HOURS", F.to_date("ts"))
    assert sorted((r["t"] is not None, r["t"], r["session"]) for r in found.collect() if r["t"] is not None) == [(True, 0, 2), (True, 9, 3)]
    assert {r["session"] for r in found.where("t IS NULL").collect()} == {1}


def test_a_hot_key_is_many_tasks(spark):
    """The plan's windows over rows are by key and cell; only those over cells are by key."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    plan = scans.scan(df, ["k"], ["t"], F.floor(F.col("t") / 10), {"s": ("sum", F.col("v"))})._jdf.queryExecution().executedPlan().toString()
    by_rows = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_cell" not in x]
    assert len(by_rows) == 1 and "_cell" in plan  # of the table of cells
    with pytest.raises(ValueError):
        scans.near_rows(df, ["k"], ["t"], F.lit(0), 5, 0, lambda w: {}, block=3)


@pytest.mark.parametrize("before, width", [(0, None), (3, None), (50, 7)])
def test_over_range(spark, before, width):
    """Nulls in key, order and value, ties, frames without a value, the least number, clashing names."""
    rng = random.Random(before)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, *range(-20, 20)]), rng.choice([None, None, 1, 5])) for i in range(150)] + [(900, 1, -(2**63), 4), (901, 1, 2**63 - 1, None)]
    df = spark.createDataFrame(rows, "id int, k int, t long, v long").repartition(3).withColumn("_end", F.lit("e"))
    with pytest.raises(ValueError):
        scans.over_range(df, ["k"], "t", before, {"x": ("max", F.col("v"))})
    found = scans.over_range(df, ["k"], "t", before, {"n": ("count", F.lit(1)), "total": ("sum", F.col("v"))}, width)
    assert found.columns == [*df.columns, "n", "total"]
    frame = lambda k, t: [v for _, m, u, v in rows if m == k and (u is None if t is None else u is not None and t - before <= u <= t)]
    for r in found.collect():
        held = frame(r["k"], r["t"])
        assert (r["n"], r["total"]) == (len(held), sum(v for v in held if v is not None) if any(v is not None for v in held) else None)


def test_over_range_does_not_go_through_frames(spark):
    """One key, all rows in each other's frames: 200,000 rows would be 2e10 steps."""
    df = spark.range(200_000).select("id", F.lit(1).alias("k"))
    found = scans.over_range(df, ["k"], "id", 1_000_000, {"n": ("count", F.lit(1))})
    assert found.where("n <> id + 1").count() == 0
    frames = re.findall(r"frame\((\w+, [^,]*),", found._jdf.queryExecution().optimizedPlan().toString().lower())
    assert frames and all("unboundedpreceding" in f for f in frames)
