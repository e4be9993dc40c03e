"""Sets that are alike, found by minima of hashes and checked exactly."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from quern.operators import scans
from quern.sources import files

#: Bands and minima in a band: a pair with a Jaccard of 0.75 shares no band with a probability of 7e-8.
BANDS, ROWS = 30, 3
#: Buckets of a small set at most: those of more items go by bands.
MOST_KEYS = 64
#: Ids in a cell of a bucket that is ranked.
CELL = 1_000_000


def minima(items: Column, n: int) -> Column:
    """The least of n seeded 64-bit hashes over an array's items; two sets agree at a place with the probability of their Jaccard."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda seed: F.array_min(F.transform(items, lambda x: F.xxhash64(x, seed))))


def bands(minima_: Column, bands_: int, rows: int) -> Column:
    """A bucket for each band of minima."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands_ - 1)), lambda i: F.xxhash64(F.slice(minima_, i * rows + 1, rows), i))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays of different items."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def small_keys(least: float) -> dict[int, list[tuple[int, int, int, int]]]:
    """For sets of n items, n from 1 on, the buckets (low, high, i, j) in which each two that are alike meet for certain.

    Different sets of n and m items with a Jaccard of ``least`` have at least o in common, so among the first n - o + 2 and m - o + 2 of their items, in any
    order that holds for all sets, at least two. A bucket is the sizes and two such items, i and j in the order (one item, if o is 1). Sizes
    end before the first that has more than MOST_KEYS buckets.
    """

    def partners(n: int) -> list[tuple[int, int]]:
        sizes = range(max(1, math.ceil(least * n - 1e-9)), math.floor(n / least + 1e-9) + 1)
        common = [(m, math.ceil(least * (n + m) / (1 + least) - 1e-9)) for m in sizes]
        return [(m, max(o, 1)) for m, o in common if o <= min(n, m) - (n == m)]

    def keys(n: int) -> list[tuple[int, int, int, int]]:
        told = []
        for m, o in partners(n):
            places = combinations(range(n - o + 2), 2) if o > 1 else [(i, i) for i in range(n)]
            told += [(min(n, m), max(n, m), i, j) for i, j in places]
        return told

    found, n = {}, 1
    while len(own := keys(n)) <= MOST_KEYS:
        found[n] = own
        n += 1
    return {n: [k for k in own if k[1] in found] for n, own in found.items()}


def first_alike(df: DataFrame, key: str, items: str, least: float = 0.75, bands_: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Adds first: the least key of a row whose set of items has a Jaccard of ``least`` or more with this one's, its own if there is none less.

    Equal sets are one, so copies cost nothing. Small ones meet in the buckets of :func:`small_keys`, which miss no pair; a pair with a larger one by bands of minima.
    In a bucket each looks through those with less keys from the least on, one, then four more, then
    sixteen, and stops at the first that is alike; so a large group of alike sets costs a few pairs a set, and no partner is left out. Pairs are checked by their items. All joins
    sort both sides: the files between them are packed so well that Spark would take them for small and send them to the driver. Null
    items don't count; sets without items, null ones and rows without a key are alike to none. Keys are whole numbers. Rows that repeat a key each have their own set.
    """
    spark = df.sparkSession
    marked = df.withColumn("_set", F.array_sort(F.array_distinct(F.array_compact(F.col(items))))).withColumn("_key", F.col(key).cast("long"))
    usable = marked.where(F.col("_key").isNotNull() & (F.size("_set") > 0))
    sets = usable.groupBy(F.col("_set").alias("set")).agg(F.min("_key").alias("id")).withColumn("hash", F.xxhash64("set"))
    sets = files.round_trip(sets, "parquet")  # written, or each use would group again
    keys = small_keys(least)
    small = max(keys, default=0)
    rows_of = [(n, *k) for n, own in keys.items() for k in own]
    table = F.broadcast(spark.createDataFrame(rows_of, "_n int, low int, high int, i int, j int"))
    hashed = sets.select("hash", "id", F.size("set").alias("_n"), F.array_sort(F.transform("set", lambda x: F.xxhash64(x))).alias("h"))
    by_items = hashed.join(table, "_n").select("hash", "id", F.xxhash64("low", "high", F.col("h")[F.col("i")], F.col("h")[F.col("j")]).alias("bucket"))
    large = sets.where(F.size("set") >= math.ceil(least * (small + 1) - 1e-9))
    large = files.round_trip(large.select("hash", "id", minima(F.col("set"), bands_ * rows).alias("minima")), "parquet")  # written, or each band would find the minima again
    placed = by_items.union(large.select("hash", "id", F.explode(bands(F.col("minima"), bands_, rows)).alias("bucket")))
    placed = files.round_trip(placed, "parquet")
    ranked = scans.ranks(placed, ["bucket"], ["id", "hash"], F.floor(F.col("id") / CELL), {"row_number": "place", "rows": "members"})
    members = files.round_trip(ranked.where("members > 1").drop("members"), "parquet")
    links = spark.createDataFrame([], "hash long, id long, other long")
    low, step, open_ = 1, 1, members.where("place > 1")
    while not open_.isEmpty():
        asked = open_.withColumn("at", F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.col("place") - 1, F.lit(low + step - 1).cast("long")))))
        met = members.select("bucket", F.col("place").alias("at"), F.col("id").alias("other"), F.col("hash").alias("other_hash"))
        pairs = asked.join(met.hint("merge"), ["bucket", "at"])
        different = pairs.select("hash", "id", "other", "other_hash").distinct()
        own, others = sets.select("hash", "id", "set"), sets.select(F.col("hash").alias("other_hash"), F.col("id").alias("other"), F.col("set").alias("other_set"))
        alike = different.join(own.hint("merge"), ["hash", "id"]).join(others.hint("merge"), ["other_hash", "other"]).where(jaccard(F.col("set"), F.col("other_set")) >= least)
        alike = files.round_trip(alike.select("hash", "id", "other", "other_hash"), "parquet")
        links = links.union(alike.groupBy("hash", "id").agg(F.min("other").alias("other")))
        done = pairs.join(alike.hint("merge"), ["hash", "id", "other", "other_hash"], "left_semi").select("bucket", "hash", "id").distinct()
        low, step = low + step, step * 4
        open_ = files.round_trip(open_.where(F.col("place") > low).join(done.hint("merge"), ["bucket", "hash", "id"], "left_anti"), "parquet")
    best = links.groupBy("hash", "id").agg(F.min("other").alias("_other")).withColumnsRenamed({"hash": "_of_hash", "id": "_of_id"})
    named = sets.select(F.col("set").alias("_of_set"), F.col("hash").alias("_of_hash"), F.col("id").alias("_of_id")).join(best.hint("merge"), ["_of_hash", "_of_id"], "left")
    fits = marked["_key"].isNotNull() & (marked["_set"] == named["_of_set"])
    found = marked.join(named.hint("merge"), fits, "left").withColumn("first", F.coalesce(F.least("_key", "_of_id", "_other"), F.col("_key")))
    return found.select(*df.columns, "first")
