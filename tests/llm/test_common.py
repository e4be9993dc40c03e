import random
from bisect import bisect_left

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import common


@pytest.mark.parametrize("keys", [[], [5], [None, None], list(range(100)), [7] * 50 + [9, None, -3], [2**62, -(2**62), 0]])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_ranges(spark, keys, size):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    bounds = common.range_bounds(df, "k", size)
    there = [k for k in keys if k is not None]
    assert bounds == sorted(set(bounds)) and set(bounds) <= set(there)
    assert not there or bounds[-1] == max(there)
    for r in df.select("k", common.bucket_of(F.col("k"), bounds).alias("b")).collect():
        assert r["b"] == (0 if r["k"] is None else bisect_left(bounds[:-1], r["k"]))


def test_at_most_so_many_bounds(spark):
    assert len(common.range_bounds(spark.range(10_000).withColumnRenamed("id", "k"), "k", 1, most=16)) <= 16


@pytest.mark.parametrize("n, most, fine", [(0, 16, 4), (1, 3, 128), (40, 16, 4), (5000, 16, 4), (5000, 16, 128), (5000, 16_384, 2)])
def test_ranges_stay_small(spark, n, most, fine):
    """Two levels of bounds give ranges of bounded rows, however few bounds the driver may hold."""
    df = spark.createDataFrame([(3 * i,) for i in range(n)] + [(None,)], "k long")
    rows = sorted(common.with_ranges(df, "k", 8, most=most, fine=fine).collect(), key=lambda r: -1 if r["k"] is None else r["k"])
    assert len(rows) == n + 1
    numbers = [r["_range"] for r in rows]
    assert numbers == sorted(numbers) and numbers[0] == 0
    if n <= 8 * most * fine:
        assert max([numbers.count(x) for x in set(numbers)]) <= 24
    given = [r for r in rows if r["k"] is not None]
    for r, after in zip(given, given[1:] + [None]):
        assert r["k"] <= r["_last"] and (after is None or (after["_range"] == r["_range"]) == (r["k"] < r["_last"]))
        assert r["_next"] == min((x for x in numbers if x > r["_range"]), default=None)


def test_whole_runs():
    random.seed(1)
    rows = sorted((random.randint(0, 6), random.randint(0, 2)) for _ in range(60))
    table = pd.DataFrame(rows, columns=["a", "b"])
    for size in (1, 3, 60, 100):
        batches = [table.iloc[i : i + size] for i in range(0, 60, size)]
        parts = list(common.whole_runs(iter([table.iloc[:0], *batches]), ["a", "b"]))
        assert [tuple(r) for p in parts for r in p.itertuples(index=False)] == rows
        ends = [tuple(p.iloc[-1]) for p in parts[:-1]]
        assert all(tuple(p.iloc[0]) != e for p, e in zip(parts[1:], ends, strict=True))
    assert list(common.whole_runs(iter([]), ["a"])) == []


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("x", F.lit(None).cast("array<double>"))
    again = common.materialize(df)
    assert again.schema.simpleString() == df.schema.simpleString() and again.count() == 10


def test_crc32_of_ids(spark):
    import zlib

    df = spark.createDataFrame([(0,), (12345,), (None,), (-7,)], "doc_id long").select("doc_id", common.crc32_of_id().alias("c"))
    assert all(r["c"] == zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") for r in df.collect())
