import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import near_vectors as nv, queries


def brute(vectors, least=0.95):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= least
    label = np.arange(len(unit))
    while True:
        low = np.array([label[row].min() for row in linked])
        if np.array_equal(low, label):
            return linked.sum(axis=1) - 1, label
        label = low


def clustered(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 4, dim))
    return centres[rng.integers(0, len(centres), n)] + rng.uniform(0, 0.3, (n, 1)) * rng.standard_normal((n, dim))


def frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("block", [3, 2048])
def test_same_links_as_brute_force(spark, block):
    vectors = clustered(400)
    vectors[300:360] = vectors[7] + 0.02 * np.random.default_rng(1).standard_normal((60, 24))
    vectors[390:] = vectors[0]
    links, label = brute(vectors)
    rows = sorted(nv.near_duplicates(frame(spark, vectors), block=block).collect())
    found = np.array([r["n_links"] for r in rows])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    assert np.mean([r["component_id"] == c for r, c in zip(rows, label, strict=True)]) > 0.97
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in rows)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5e-300, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, []), (None, [1.0, 0.0]), (11, [1e300, 1e299]), (12, [-1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "extra", 1) for r in rows], "vec_id long, embedding array<double>, vec string, rep int")
    found = nv.near_duplicates(vectors).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in found) == sorted(
        [("1", 3, 1, True), ("2", 3, 1, False), ("2", 3, 1, False), ("3", 3, 1, False), ("11", 3, 1, False), ("None", 0, None, True)] + [(str(i), 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12)]
    )
    assert nv.near_duplicates(vectors.limit(0)).count() == 0


def test_plan_and_calibration():
    for n in (1, 1000, 10**6):
        bits, tables = nv.plan(n)
        together = (1 - math.acos(0.95) / math.pi) ** bits * math.erf(nv.HALF_WINDOW / math.sqrt(2))
        assert 1 - (1 - together) ** tables >= nv.RECALL
    rng = np.random.default_rng(3)
    a = rng.standard_normal((2000, 64))
    gap = math.sqrt(2 - 2 * 0.95)
    counts = (np.abs(a * gap) <= nv.HALF_WINDOW * gap).sum(axis=1)
    assert (counts >= nv.least_count()).mean() > 0.995


def test_windows_hold_just_the_close_pairs():
    rng = np.random.default_rng(5)
    run, value = rng.integers(0, 9, 300), rng.normal(size=300)
    found = sorted(tuple(sorted(map(int, p))) for a, b in nv._window_pairs(run, value, 0.2) for p in zip(a, b, strict=True))
    assert found == [(i, j) for i in range(300) for j in range(i + 1, 300) if run[i] == run[j] and abs(value[i] - value[j]) <= 0.2]


def test_plain_method(spark):
    """Without cells every window is over the whole table."""
    vectors = clustered(200, seed=4)
    links, _ = brute(vectors)
    for block in (60, 2048):
        found = np.array([r["n_links"] for r in sorted(nv.near_duplicates(frame(spark, vectors), bits=0, block=block).collect())])
        assert (found <= links).all() and found.sum() >= 0.97 * links.sum()


def planted(n, dim, rng):
    """Pairs at a cosine from 0.95 to 0.97 among others, and one large group of near copies."""
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((n, dim))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.97, (n, 1))
    group = base[0] + 0.02 * rng.standard_normal((n // 2, dim))
    return np.vstack([base, cosine * base + np.sqrt(1 - cosine**2) * side, group])


def test_query_finds_planted_pairs(spark, tmp_path):
    vectors = planted(600, 64, np.random.default_rng(8)).astype(np.float32)
    frame(spark, vectors).withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    links, label = brute(vectors.astype(np.float64))
    rows = sorted(queries.op6_near_vectors(spark, f"file://{tmp_path}").collect())
    found = np.array([r["n_links"] for r in rows])
    assert (found <= links).all()
    assert found[1:600].sum() >= 0.95 * links[1:600].sum() and links[1:600].sum() >= 550
    assert found[1200:].sum() >= 0.99 * links[1200:].sum()
    assert np.mean([r["component_id"] == c for r, c in zip(rows, label, strict=True)]) > 0.95


def test_query_recall(spark, sf):
    given = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    links, _ = brute(np.array([v for _, v in given], dtype=np.float64))
    found = sorted(queries.op6_near_vectors(spark, sf).collect())
    assert [r["vec_id"] for r in found] == [i for i, _ in given]
    assert sum(r["n_links"] for r in found) >= 0.9 * links.sum() and all(r["n_links"] <= n for r, n in zip(found, links, strict=True))
