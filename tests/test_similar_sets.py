"""Similar sets against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import similar_sets


def brute(rows, least):
    sets = [(k, {x for x in s or [] if x is not None}) for k, s in rows]
    out = []
    for k, s in sets:
        alike = [j for j, t in sets if k is not None and j is not None and s and t and j < k and len(s & t) / len(s | t) >= least]
        out.append((k, min(alike, default=k)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    """A large group of near copies, exact copies, chance pairs, empty and null sets, null items, repeated and null keys, clashing names."""
    rng = random.Random(seed)
    base = list(range(100, 112))
    rows = [(i, rng.sample(range(30), rng.randint(1, 5))) for i in range(60)]
    rows += [(100 + i, base[: i % 12] + base[i % 12 + 1 :] + [200 + i] * (i % 2)) for i in range(60)]
    rows += [(200, base), (201, base), (202, base[::-1] + base), (203, []), (204, None), (205, [None, *base]), (206, [None]), (200, [7]), (None, base)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, items array<int>").repartition(3).withColumns({"id": F.lit(1), "hash": F.lit("h"), "place": F.lit(0)})
    found = similar_sets.first_alike(df, "k", "items")
    assert found.columns == [*df.columns, "first"]
    assert sorted(((r["k"], r["first"]) for r in found.collect()), key=repr) == brute(rows, 0.75)


def test_texts_by_words(spark):
    texts = [(1, "a b c d e f g h"), (2, "x y z"), (3, "a b c d e f g i"), (4, "x y z"), (5, "")]
    df = spark.createDataFrame(texts, "k long, t string").withColumn("w", F.filter(F.split("t", " "), lambda x: x != ""))
    assert sorted((r["k"], r["first"]) for r in similar_sets.first_alike(df, "k", "w").collect()) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 5)]


def test_empty(spark):
    assert similar_sets.first_alike(spark.createDataFrame([], "k long, s array<int>"), "k", "s").count() == 0


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9])
def test_small_sets_meet_for_certain(least):
    """Each two sets that are alike share a bucket, and two that share few items don't."""
    rng, keys = random.Random(3), similar_sets.small_keys(least)
    told = lambda s: {(low, high, sorted(s)[i], sorted(s)[j]) for low, high, i, j in keys[len(s)]}
    alike = 0
    for _ in range(4000):
        a = set(rng.sample(range(1000), rng.randint(1, max(keys))))
        b = set(rng.sample(sorted(a), max(1, len(a) - rng.randint(0, 3)))) | set(rng.sample(range(1000), rng.randint(0, 2)))
        if a != b and len(b) in keys and len(a & b) / len(a | b) >= least:
            alike += 1
            assert told(a) & told(b)
    assert alike > 200 and all(len(k) <= similar_sets.MOST_KEYS for k in keys.values())
    assert not told({1, 2, 3}) & told({3, 4, 5, 6})


def test_nothing_large_is_broadcast(spark):
    """Files between the steps are small when packed, so Spark would send them to the driver; and sets of few items in common are not compared."""
    df = spark.range(3000).select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(40))).alias("s"))
    found = similar_sets.first_alike(df, "id", "s")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r["id"], r["s"]) for r in df.collect()]
    by = {}
    for k, s in rows:
        s = frozenset(s)
        for t in [s, *(s - {x} for x in s if len(s) == 4), *(s | {x} for x in range(40) if len(s) == 3)]:
            by.setdefault(t, []).append((k, s))
    expected = {k: min([j for t in [frozenset(s)] for j, u in by.get(t, []) if len(t & u) / len(t | u) >= 0.75] + [k]) for k, s in rows}
    assert {r["id"]: r["first"] for r in found.collect()} == expected
