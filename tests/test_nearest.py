"""Nearest vectors against brute force, with rows that are no vectors among them."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from quern.operators import nearest

NAN, INF = float("nan"), float("inf")
BAD = [(900, [0.0] * 8), (901, None), (902, [NAN] + [1.0] * 7), (903, [INF] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, []), (None, [1.0] * 8)]


def rows_of(n, dims=8, seed=1, groups=12):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [c + rng.gauss(0, 0.3) for c in centers[i % groups]]) for i in range(n)]


def brute(asked, among):
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    data = [(i, unit(v)) for i, v in among if i is not None and fine(v)]
    out = {}
    for i, v in asked:
        if i is not None and fine(v):
            u = unit(v)
            best = max(((round(sum(a * b for a, b in zip(u, w)), 9), -j) for j, w in data if j != i and len(w) == len(u)), default=None)
            if best:
                out[i] = -best[1]
    return out


def test_exact_with_rows_that_are_no_vectors(spark, monkeypatch):
    """Also other dims, copies (the least id), an id with two vectors, a vector alone in its dims, very large and small numbers."""
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rows = rows_of(60) + rows_of(10, dims=3, seed=2, groups=2) + BAD
    rows = [(i if i is None or len(v or [0] * 8) != 3 else i + 500, v) for i, v in rows] + [(700, rows_of(60)[5][1]), (701, rows_of(60)[5][1]), (20, [1e200, 1e-200] + [1.0] * 6), (800, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [r for r in rows if r[0] is None or r[0] % 5 == 0]
    found = nearest.nearest(df.where("vec_id % 5 = 0 OR vec_id IS NULL"), df, "vec_id", "embedding").collect()
    assert {r["query_id"] for r in found}.isdisjoint({900, 905, 800})
    told, expected = {r["query_id"]: r["nearest"] for r in found}, brute([r for r in asked if r[0] != 20], rows)
    assert {k: v for k, v in told.items() if k != 20} == expected and 20 in told


def test_one_bad_row_loses_nothing(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    asked = df.where("vec_id % 20 = 0")
    clean = sorted(tuple(r) for r in nearest.nearest(asked, df, "vec_id", "embedding").collect())
    bad = spark.createDataFrame([(10_000, [0.0] * 64), (10_001, None), (10_002, [NAN] * 64)], df.schema)
    both = df.unionByName(bad)
    assert len(clean) == asked.count() == 25
    found = sorted(tuple(r) for r in nearest.nearest(asked.unionByName(bad), both, "vec_id", "embedding").collect())
    assert [r[:2] for r in found] == [r[:2] for r in clean]


def test_plan_has_no_broadcast(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = nearest.nearest(df.where("vec_id % 20 = 0"), df, "vec_id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n", [0, 1, 400])
def test_lists(spark, n):
    """Every vector is in a list: with all lists asked the result is exact; with those of the calibration recall is 0.9."""
    rows = rows_of(n, groups=20) + BAD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lists = nearest.fit_lists(df, "vec_id", "embedding")
    expected = brute(rows, rows)
    found = {r["query_id"]: r["nearest"] for r in nearest.nearest_in_lists(df, df, "vec_id", "embedding", lists).collect()}
    assert sum(found.get(k) == v for k, v in expected.items()) >= 0.9 * len(expected) and set(found) <= set(expected)
    if n == 400:
        assert lists.probes[8] < len(lists.centroids[8])
        lists.probes = {k: len(c) for k, c in lists.centroids.items()}
        found = {r["query_id"]: r["nearest"] for r in nearest.nearest_in_lists(df, df, "vec_id", "embedding", lists).collect()}
        assert found == expected


def test_queries_are_dealt_a_few_at_a_time():
    """A batch of queries times the lists each asks never stands in memory whole."""
    batch = pd.DataFrame([(i, np.array(v), len(v)) for i, v in rows_of(3000)] + [(9000, np.ones(3), 3)], columns=["id", "vector", "dims"])
    lists = nearest.Lists({8: np.random.default_rng(1).normal(size=(64, 8))}, {8: 40})
    found = list(nearest.listed(iter([batch]), lists, True))
    assert max(map(len, found)) <= nearest.LISTED and sum(map(len, found)) == 3000 * 40 + 1
    whole = lists.nearest_lists(8, np.stack(batch["vector"][:3000].to_numpy()), 40)
    assert (np.concatenate([f["of"] for f in found if f["dims"].iloc[0] == 8]).reshape(3000, 40) == whole).all()
    assert [len(f) for f in nearest.listed(iter([batch]), lists, False)][:1] == [1] and sum(len(f) for f in nearest.listed(iter([batch]), lists, False)) == 3001


def test_blocks_by_slices(spark, monkeypatch):
    """A block is compared a slice at a time, and gives what it gives whole."""
    monkeypatch.setattr(nearest, "SLICE", 3)
    rows = rows_of(100) + BAD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    plan = nearest.nearest(df, df, "vec_id", "embedding")
    assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()
    assert {r["query_id"]: r["nearest"] for r in plan.collect()} == brute(rows, rows)
