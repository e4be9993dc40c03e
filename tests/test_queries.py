"""Every query with SQL gives DuckDB's rows; the others give rows."""

import datetime
import math
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.catalog import TABLES
from quern.plans import aggregating, databases, files_and_streams, joining, more, relational, scalars  # noqa: F401
from quern.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    told = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(told.columns)
    assert table(found.columns, found.collect()) == table(told.columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def within(found, exact, share):
    return abs(found - exact) <= share * exact


def test_approximate_counts_are_near(spark, sf, duck):
    exact = {r[0]: r[1:] for r in duck.sql("SELECT l_returnflag, count(DISTINCT l_partkey), count(DISTINCT l_orderkey), list_sort(list(l_extendedprice)) FROM lineitem GROUP BY 1").fetchall()}
    often = {}
    for flag, supplier, n in duck.sql("SELECT l_returnflag, l_suppkey, count(*) FROM lineitem GROUP BY ALL").fetchall():
        often.setdefault(flag, []).append(n)
    for r in QUERIES["approximate_counts"](spark, sf).collect():
        parts, orders, prices = exact[r["l_returnflag"]]
        assert within(r["parts"], parts, 0.08) and within(r["orders"], orders, 0.08)
        for q, found in zip((0.5, 0.99), r["prices"], strict=True):
            assert abs(sum(p <= found for p in prices) / len(prices) - q) <= 0.01
        assert [x["count"] for x in r["suppliers"]] == sorted(often[r["l_returnflag"]], reverse=True)[:5]


def test_sketches_are_near(spark, sf, duck):
    exact = {r[0]: r[1:] for r in duck.sql("SELECT l_returnflag, list_sort(list(l_extendedprice)), count(DISTINCT l_orderkey) FROM lineitem GROUP BY 1").fetchall()}
    for r in QUERIES["sketches"](spark, sf).collect():
        prices, orders = exact[r["l_returnflag"]]
        assert abs(sum(p <= r["middle"] for p in prices) / len(prices) - 0.5) <= 0.03 and within(r["orders"], orders, 0.08)


def test_count_min_counts_all_rows(spark, sf, duck):
    """The sketch's head: version, total count, depth, width."""
    exact = dict(duck.sql("SELECT l_returnflag, count(*) FROM lineitem GROUP BY 1").fetchall())
    found = {r["l_returnflag"]: struct.unpack(">iqii", bytes(r["sketch"])[:20]) for r in QUERIES["count_min"](spark, sf).collect()}
    assert {k: v[1] for k, v in found.items()} == exact and all(v[2:] == (7, 2000) for v in found.values())


def test_hashes_are_the_library_s(spark, sf, duck):
    names = dict(duck.sql("SELECT p_partkey, p_name FROM part").fetchall())
    for r in QUERIES["xx_hashes"](spark, sf).collect():
        assert r["x"] % 2**64 == xxhash.xxh64_intdigest(names[r["p_partkey"]].encode(), 42)


def test_sounds(spark, sf, duck):
    known = {"Robert": "R163", "Rupert": "R163", "Tymczak": "T522", "Pfister": "P236", "Honeyman": "H555"}
    found = spark.createDataFrame([(k,) for k in known], "name string").select("name", F.soundex("name").alias("s")).collect()
    assert {r["name"]: r["s"] for r in found} == known
    assert sum(r["n"] for r in QUERIES["sound_keys"](spark, sf).collect()) == duck.sql("SELECT count(*) FROM part").fetchall()[0][0]


@pytest.mark.parametrize("name, share", [("sample_fraction", 0.2), ("sample_percent", None)])
def test_samples_repeat(spark, sf, name, share):
    first, again = QUERIES[name](spark, sf), QUERIES[name](spark, sf)
    rows = sorted(map(str, first.collect()))
    assert rows and rows == sorted(map(str, again.collect()))
    assert share is None or within(len(rows), share * spark.read.parquet(f"{sf}/events.parquet").count(), 0.25)


def test_arg_extremes_with_ties(spark, tmp_path):
    """Copies of the table with shifted keys: every highest and lowest balance comes several times; nulls and nations without a balance."""
    rows = [(k + 100 * i, k % 3, [5.0, 7.0, -1.0, 7.0, 5.0, -1.0][k % 6]) for i in range(4) for k in range(30)] + [(900, 0, None), (None, 0, 99.0), (None, 1, -99.0), (901, 7, None)]
    spark.createDataFrame(rows[::-1], "c_custkey long, c_nationkey int, c_acctbal double").repartition(7).write.parquet(f"file://{tmp_path}/shuffled.parquet")
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    told = sorted(con.sql(ORACLES["arg_extremes"]).fetchall())
    (tmp_path / "customer.parquet").rename(tmp_path / "ordered.parquet")
    (tmp_path / "shuffled.parquet").rename(tmp_path / "customer.parquet")
    assert sorted(tuple(r) for r in QUERIES["arg_extremes"](spark, f"file://{tmp_path}").collect()) == told
