"""Pieces that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import itertools
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of every operator here: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: At most so many ranges have their bounds on the driver (:func:`range_bounds`), each from about so many keys.
MOST_RANGES = 16_384
CUTS_FROM = 20
#: Ranges into which :func:`with_ranges` cuts each of those.
FINE = 128

_own_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local runs where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="spark-quern-")
    return _own_scratch[app]


def new_dir(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when the JVM ends."""
    path = f"{shared_dir(spark)}/quern-{kind}{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: it cuts the lineage, and a lost executor costs nothing."""
    path = new_dir(df.sparkSession, "")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A :func:`materialize` whose files go at the end of the block, when nothing may read them any more."""
    made: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        made.append(new_dir(spark, ""))
        df.write.option("compression", "zstd").parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        yield put
    finally:
        for path in made:
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def give_back() -> None:
    """Returns a Python worker's freed memory to the system; Spark keeps workers, and what they hold, between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have, in any case of letters."""
    there = {c.lower() for c in df.columns}
    return next(x for i in itertools.count() if (x := f"_{name}{i}") not in there)


def crc32_of_id(column: str = "doc_id") -> Column:
    """Unsigned crc32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def range_bounds(df: DataFrame, key: str, rows_per_range: int, most: int = MOST_RANGES) -> list[int]:
    """Ascending values of an integer key that cut its rows into ranges of about rows_per_range.

    Each value occurs in the data and is the last of its range, so no range is empty. The cuts are quantiles of
    about CUTS_FROM keys a range, which a hash picks, and at most so many and ``most`` of them come to the driver; they
    decide how even the ranges are, never what is in the result. Empty if df has no row with a key.
    """
    told = df.agg(F.count(key).alias("n"), F.max(key).alias("top")).first()
    parts = max(1, min(most, math.ceil(told["n"] / rows_per_range)))
    if parts == 1:
        return [] if told["top"] is None else [told["top"]]
    found = sorted(r[0] for r in _picked(df, key, CUTS_FROM * parts / told["n"]).distinct().collect())
    return sorted({*(found[len(found) * i // parts] for i in range(1, parts) if found), told["top"]})


def _picked(df: DataFrame, key: str, share: float) -> DataFrame:
    """The keys of a share of the rows, by a hash of the key; all of them for a share of 1 or more."""
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key))
    return keys if share >= 1 else keys.where(F.pmod(F.xxhash64(F.lit("range"), key), F.lit(1_000_000_007)) < int(share * 1_000_000_007))


def with_ranges(df: DataFrame, key: str, rows_per_range: int, most: int = MOST_RANGES, fine: int = FINE) -> DataFrame:
    """Adds _range, the number of the range of about rows_per_range rows that holds key, its last key as _last, and the
    number of the next range as _next (null after the last range).

    The bounds of :func:`range_bounds` are cut again, each by up to ``fine`` bounds of its own that never leave Spark;
    ``most`` times ``fine`` numbers at most (17 MB) are broadcast to the rows. So ranges stay small in very large
    tables. Null keys are in the first range.
    """
    coarse = range_bounds(df, key, rows_per_range * fine, most)
    n = df.where(F.col(key).isNotNull()).count()
    place = bucket_of(F.col(key), coarse).alias("_coarse")
    picked = _picked(df, key, CUTS_FROM * fine * len(coarse) / max(1, n)).distinct().select(place, key)
    parts = F.least(F.lit(fine), F.lit(math.ceil(n / rows_per_range / max(1, len(coarse)))))
    lists = df.sparkSession.range(max(1, len(coarse))).select(F.col("id").cast("int").alias("_coarse"))
    lists = lists.join(picked.groupBy("_coarse").agg(F.array_sort(F.collect_list(key)).alias("_keys")), "_coarse", "left")
    inner = F.transform(F.sequence(F.lit(0), parts), lambda i: F.get("_keys", F.floor(F.size("_keys") * i / parts).cast("int")))
    last = F.get(F.lit(coarse).cast("array<long>"), F.col("_coarse")) if coarse else F.lit(None).cast("long")
    cuts = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.slice(inner, 2, 2**30), F.array(last)))))
    cut = df.withColumn("_coarse", place).join(F.broadcast(lists.select("_coarse", cuts.alias("_cuts"))), "_coarse")
    cut = cut.withColumn("_at", bisect(F.col("_cuts"), F.size("_cuts") - 1, F.col(key), fine))
    number = F.col("_coarse").cast("long") * (fine + 1)
    following = F.when(F.col("_at") + 1 < F.size("_cuts"), number + F.col("_at") + 1).when(F.col("_coarse") + 1 < len(coarse), number + fine + 1)
    found = cut.withColumns({"_range": number + F.col("_at"), "_last": F.get("_cuts", F.col("_at")), "_next": following})
    return found.drop("_coarse", "_cuts", "_at")


def bisect(cuts: Column, n: Column, key: Column, most: int) -> Column:
    """How many of the first n (at most ``most``) ascending cuts lie below key; 0 for a null key."""
    steps = F.lit([2**i for i in reversed(range(most.bit_length()))])

    def step(low: Column, width: Column) -> Column:
        inside = (low + width <= n) & (F.get(cuts, low + width - 1) < key)
        return F.when(inside, low + width).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Position of the range that holds key: how many bounds but the last lie below it (0 for a null key)."""
    return bisect(F.lit(bounds[:-1]), F.lit(len(bounds) - 1), key, len(bounds)) if len(bounds) > 1 else F.lit(0)


def whole_runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The same rows, cut only where one of the sorted columns ``by`` changes."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        last = np.logical_and.reduce([rows[c].to_numpy() == rows[c].iloc[-1] for c in by])
        start = int(np.argmax(last))
        same = held and all(held[-1][c].iloc[-1] == rows[c].iloc[-1] for c in by)
        if start == 0 and same:
            held.append(rows)
            continue
        ready = pd.concat([*held, rows.iloc[:start]], ignore_index=True)
        if len(ready):
            yield ready
        held = [rows.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)
