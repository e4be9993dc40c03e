"""Composed operators against brute force on small tables."""

import datetime as dt
import os

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quern.functions import text, vectors
from quern.operators import joins, windows
from quern.sources import files

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
TIMES = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9)), max_size=12)


NULLS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(0, 9))), max_size=12)


@QUIET
@given(NULLS, NULLS, st.booleans(), st.sampled_from([None, 1, 4]))
def test_asof_join(spark, left, right, strict, width):
    """Null keys and times match nothing; cells change no row."""
    l = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k int, t int, id int")
    r = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k int, t int, r int")
    cell = width and (lambda t: F.floor(t / width))
    found = {x["id"]: x["r"] for x in joins.asof_join(l, r, ["k"], "t", ["r"], strict, cell).collect()}
    assert len(found) == len(left)
    for i, (k, t) in enumerate(left):
        before = [(u, j) for j, (m, u) in enumerate(right) if None not in (k, t, m, u) and m == k and (u < t if strict else u <= t)]
        assert found[i] == (max(before)[1] if before else None)


@QUIET
@given(TIMES, TIMES)
def test_interval_pairs(spark, left, right):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    for kind in ("timestamp_ntz", "timestamp"):
        l = spark.createDataFrame([(k, at(t), i) for i, (k, t) in enumerate(left)], "k int, a timestamp_ntz, i int").withColumn("a", F.col("a").cast(kind))
        r = spark.createDataFrame([(k, at(t), j) for j, (k, t) in enumerate(right)], "k int, b timestamp_ntz, j int").withColumn("b", F.col("b").cast(kind))
        found = sorted((x["i"], x["j"]) for x in joins.interval_pairs(l, r, "k", "a", "3 HOURS", "b").collect())
        assert found == sorted((i, j) for i, (k, t) in enumerate(left) for j, (m, u) in enumerate(right) if k == m and t < u <= t + 3)


@QUIET
@given(NULLS, NULLS, st.sampled_from([1.0, 3.0, 100.0]))
def test_count_below(spark, left, right, width):
    l = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k int, v int, id int")
    r = spark.createDataFrame(right, "k int, w int")
    found = {x["id"]: x["n"] for x in joins.count_below(l, r, "k", "v", "w", width).collect()}
    assert found == {i: sum(None not in (k, v, m, w) and k == m and w < v for m, w in right) for i, (k, v) in enumerate(left)}


@QUIET
@given(TIMES, st.sampled_from([1, 3, 50]))
def test_over_range(spark, rows, before):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "k int, t long, id int")
    found = {x["id"]: x["n"] for x in windows.over_range(df, F.count(F.lit(1)), ["k"], "t", before, "n").collect()}
    assert found == {i: sum(m == k and t - before <= u <= t for m, u in rows) for i, (k, t) in enumerate(rows)}


@QUIET
@given(st.lists(st.tuples(st.integers(0, 1), st.one_of(st.none(), st.integers(-30, 30))), max_size=20), st.sampled_from([1.0, 7.0, 1000.0]))
def test_quantiles(spark, rows, width):
    df = spark.createDataFrame([(k, None if v is None else v / 4) for k, v in rows], "k int, v double")
    found = {x["k"]: x for x in windows.quantiles(df, ["k"], "v", width, {"a": 0.5, "b": 0.9}, {"c": 0.25, "z": 0.0}).collect()}
    told = df.groupBy("k").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.9).alias("b"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY v)").alias("c"), F.min("v").alias("z"))
    expected = {x["k"]: x for x in told.where("a IS NOT NULL").collect()}
    assert found.keys() == expected.keys()
    for k, x in found.items():
        assert [round(x[c], 9) for c in "abcz"] == [round(expected[k][c], 9) for c in "abcz"]


def test_lookup_join_broadcasts_by_bytes(spark):
    facts, lookup = spark.range(50).withColumnRenamed("id", "k"), spark.createDataFrame([(i, "x" * 100) for i in range(20)], "k long, w string")
    plans = [joins.lookup_join(facts, lookup, "k", most=most)._jdf.queryExecution().optimizedPlan().toString() for most in (10_000, 1000)]
    assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]


@QUIET
@given(st.lists(st.integers(-20, 20), max_size=10), st.lists(st.tuples(st.integers(-20, 20), st.integers(0, 9)), max_size=10), st.sampled_from([1.0, 4.0, 50.0]))
def test_band_join(spark, points, bands, width):
    l = spark.createDataFrame(enumerate(points), "a int, x int")
    r = spark.createDataFrame([(i, low, low + size) for i, (low, size) in enumerate(bands)], "b int, low int, high int")
    found = sorted((x["a"], x["b"]) for x in joins.band_join(l, r, "x", "low", "high", width).collect())
    assert found == sorted((i, j) for i, x in enumerate(points) for j, (low, size) in enumerate(bands) if low <= x <= low + size)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    big = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(100)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (95, "c"), (500, "d")], "k int, w string")
    order = ["k", "v"] + (["w"] if how in ("inner", "left") else [])
    expected = big.join(small, "k", how).select(order).orderBy(order).collect()
    assert joins.salted_join(big, small, "k", 4, how).select(order).orderBy(order).collect() == expected


def test_salted_join_refuses_what_it_would_repeat(spark):
    with pytest.raises(ValueError):
        joins.salted_join(spark.range(1), spark.range(1), "id", how="right")


def test_groups_frame_counts_peers(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 1, 20), ("a", 5, 1), ("a", 9, 2)], "k string, o int, v int")
    found = windows.over_groups(rows, F.sum("v"), ["k"], "o", 1, 0, "s").orderBy("o", "v").collect()
    assert [x["s"] for x in found] == [30, 30, 31, 3]


def test_sessions_and_gaps(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([(1, at(0), 1), (1, at(30), 2), (1, at(91), 3), (2, at(5), 4)], "u int, ts timestamp_ntz, event_id int")
    found = windows.sessions(rows, "u", "ts", "1 HOUR").orderBy("event_id").collect()
    assert [x["session"] for x in found] == [1, 1, 2, 1]
    days = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5), ("a", dt.date(2024, 1, 4), 7)], "k string, d date, v int")
    assert [x["v"] for x in windows.gaps_filled(days, "k", "d", "DAY", "v").orderBy("d").collect()] == [5, 5, 5, 7]


def test_top_per_group_with_ties(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert windows.top_per_group(rows, ["k"], [F.col("v")], 1).count() == 2
    assert windows.top_per_group(rows, ["k"], [F.col("v")], 1, ties=True).count() == 3


def test_vectors_and_ngrams(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0], "One two, THREE")], "a array<double>, b array<double>, z array<double>, t string")
    got = row.select(
        vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("n"), vectors.squared_distance(F.col("a"), F.col("b")).alias("d"),
        text.ngrams(text.words(F.col("t")), 2).alias("g"), text.ngrams(text.words(F.col("t")), 9).alias("e"), text.initials(F.col("t")).alias("i"),
    ).first()
    assert (round(got["c"], 9), got["n"], got["d"], got["g"], got["e"], got["i"]) == (0.96, None, 2.0, ["one two", "two three"], [], "OTT")


def test_files_refuse_unknown_formats(spark):
    with pytest.raises(ValueError):
        files.write(spark.range(1), "/tmp/never", "avro")


def test_plans_push_down_and_prune(spark, sf):
    from quern.plans import relational

    plan = relational.scan_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,400000.0)" in plan and "o_custkey" not in plan


def test_scan_files_and_work_dirs(spark, sf):
    found = files.scan_files(spark, f"{sf}/orders.parquet").collect()
    assert [r["length"] for r in found] == [os.path.getsize(f"{sf}/orders.parquet")]
    assert files.work_dir(spark) != files.work_dir(spark)
