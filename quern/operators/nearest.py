"""Nearest vectors by cosine: exactly, by blocks of both sides, and by lists around centroids.

Rows are (id, vector). A null id, a null or empty vector, one of length zero and one with a null or non-finite component are no vectors: they find nothing, nothing finds them,
and they change no other result. Vectors of different numbers of components are never compared. Of equally near vectors the least id counts, and rows
that repeat an id are that id's vectors all; a vector is never its own id's nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a side that are compared at once.
BLOCK = 2048
#: Rows of a block of queries that are compared at once, and queries times lists that a task holds at once.
SLICE = 256
LISTED = 8192
#: Vectors of the sample that centroids are fitted to, the most centroids, and vectors of the sample whose recall sets the lists that are asked.
SAMPLE_ROWS = 16_384
MOST_LISTS = 1_024
CALIBRATION_ROWS = 512


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector, dims) of the rows that have a vector of finite numbers and a length."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0))
    return rows.withColumn("dims", F.size("vector"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that very large and very small numbers do."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _packed(rows: DataFrame, by: str) -> DataFrame:
    """(dims, place, ids, unit): unit vectors of equal dims and ``by``, BLOCK at most together."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dims, place), some in batch.groupby(["dims", "place"], sort=False):
                for i in range(0, len(some), BLOCK):
                    part = some.iloc[i : i + BLOCK]
                    unit = _unit(np.stack(part["vector"].to_numpy()).astype(float))
                    yield pd.DataFrame({"dims": [dims], "place": [place], "ids": [part["id"].to_numpy("<i8").tobytes()], "unit": [unit.tobytes()]})

    dealt = rows.withColumnRenamed(by, "place").repartition("dims", "place").sortWithinPartitions("dims", "place")
    return dealt.select("id", "vector", "dims", "place").mapInPandas(of, "dims int, place long, ids binary, unit binary")


def _best(pairs: DataFrame) -> DataFrame:
    """(query_id, nearest, likeness) from pairs of blocks: the best of each pair, then the best of these."""

    def best(q_ids: pa.Buffer, q_unit: pa.Buffer, ids: pa.Buffer, unit: pa.Buffer) -> pa.RecordBatch:
        asked, met = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
        of_asked, of_met = np.frombuffer(q_unit).reshape(len(asked), -1), np.frombuffer(unit).reshape(len(met), -1).T
        nearest, top = np.empty(len(asked), np.int64), np.empty(len(asked))
        for i in range(0, len(asked), SLICE):
            likeness = of_asked[i : i + SLICE] @ of_met
            likeness[asked[i : i + SLICE, None] == met] = -np.inf
            top[i : i + SLICE] = likeness.max(axis=1)
            nearest[i : i + SLICE] = np.where(likeness == top[i : i + SLICE, None], met, np.iinfo(np.int64).max).min(axis=1)
        found = top > -np.inf
        return pa.record_batch({"query_id": asked[found], "nearest": nearest[found], "likeness": top[found]})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # blocks are read where they are, none is copied
            for row in zip(*(batch.column(c) for c in ("q_ids", "q_unit", "ids", "unit")), strict=True):
                yield best(*(x.as_buffer() for x in row))

    found = pairs.select("q_ids", "q_unit", "ids", "unit").mapInArrow(of, "query_id long, nearest long, likeness double")
    first = F.max_by(F.struct("nearest", "likeness"), F.struct("likeness", -F.col("nearest")))
    return found.groupBy("query_id").agg(first.alias("best")).select("query_id", "best.nearest", "best.likeness")


def nearest(asked: DataFrame, among: DataFrame, key: str, vector: str) -> DataFrame:
    """(query_id, nearest, likeness): for each vector of ``asked`` the nearest of all of ``among``, compared exactly.

    Both sides are dealt into blocks by a hash of the id, and each block of one meets each of the other, by a join on the numbers of both: nothing is
    broadcast, and a task holds a pair of blocks. The work is the product of both sides; :func:`nearest_in_lists` does less.
    """
    queries, rows = usable(asked, key, vector), usable(among, key, vector)
    n_q, n = queries.count(), rows.count()
    blocks_q, blocks = max(1, math.ceil(n_q / BLOCK)), max(1, math.ceil(n / BLOCK))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    q = _packed(queries.withColumn("of", place(blocks_q)), "of").select("dims", F.col("place").alias("q"), F.col("ids").alias("q_ids"), F.col("unit").alias("q_unit"))
    d = _packed(rows.withColumn("of", place(blocks)), "of").withColumnRenamed("place", "d")
    q = q.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    d = d.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_q - 1).cast("long"))))
    return _best(q.hint("shuffle_hash").join(d, ["dims", "q", "d"]))


@dataclass
class Lists:
    """Unit centroids by number of components, and how many lists a query asks: at most MOST_LISTS centroids a number of components."""

    centroids: dict[int, np.ndarray]
    probes: dict[int, int]

    def nearest_lists(self, dims: int, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        likeness = _unit(vectors) @ self.centroids[dims].T
        n = min(n, likeness.shape[1])
        some = np.argpartition(-likeness, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(likeness, some, axis=1), axis=1, kind="stable"), axis=1)


def fit_lists(among: DataFrame, key: str, vector: str, recall: float = 0.95) -> Lists:
    """Centroids by spherical k-means on a sample, and the lists to ask for a wanted recall there.

    The sample has at most SAMPLE_ROWS vectors, picked by a hash of the id, and is all that comes to the driver. Centroids are as many as the root of
    the number of all vectors, MOST_LISTS at most. CALIBRATION_ROWS of the sample are searched in the whole sample, and as many lists
    are asked as hold ``recall`` of their nearest ones; a sample is sparser than the table, so the table's recall is to be measured (it is in the tests).
    """
    rows = usable(among, key, vector)
    n = rows.count()
    if not n:
        return Lists({}, {})
    share = min(1.0, 0.9 * SAMPLE_ROWS / n)
    picked = rows.where(F.pmod(F.xxhash64(F.lit("lists"), "id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).limit(SAMPLE_ROWS).toPandas()
    centroids, probes = {}, {}
    for dims, some in picked.groupby("dims"):
        x = _unit(np.stack(some.sort_values("id")["vector"].to_numpy()).astype(float))
        k = max(1, min(MOST_LISTS, len(x), round(math.sqrt(n))))
        rng = np.random.default_rng(7)
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(10):
            own = (x @ c.T).argmax(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(length > 0, total / np.where(length > 0, length, 1), c)
        own, asked = (x @ c.T).argmax(axis=1), x[:CALIBRATION_ROWS]
        likeness = asked @ x.T
        likeness[np.arange(len(asked)), np.arange(len(asked))] = -2
        wanted = own[likeness.argmax(axis=1)]
        place = (np.argsort(-(asked @ c.T), axis=1, kind="stable") == wanted[:, None]).argmax(axis=1)
        centroids[int(dims)], probes[int(dims)] = c, int(np.quantile(place, recall, method="higher")) + 1
    return Lists(centroids, probes)


def listed(batches: Iterator[pd.DataFrame], lists: Lists, every: bool) -> Iterator[pd.DataFrame]:
    """Rows (id, vector, dims) with the list they are in, or each of those they ask (``every``); LISTED at most at once."""
    for batch in batches:
        for dims, rows in batch.groupby("dims"):
            n = (lists.probes[dims] if every else 1) if dims in lists.centroids else 0
            at_once = max(1, LISTED // max(n, 8))
            for i in range(0, len(rows), at_once):
                some = rows.iloc[i : i + at_once]
                own = lists.nearest_lists(dims, np.stack(some["vector"].to_numpy()).astype(float), n) if n else np.zeros((len(some), 1), np.int64)
                yield some.assign(of=list(own)).explode("of").astype({"of": "int64"})[["id", "vector", "dims", "of"]]


def nearest_in_lists(asked: DataFrame, among: DataFrame, key: str, vector: str, lists: Lists | None = None) -> DataFrame:
    """(query_id, nearest, likeness) as :func:`nearest` gives them, but of the vectors in the lists nearest to a query.

    Every vector is in the list of its nearest centroid. Lists meet queries in blocks, so a long list is many blocks. Numbers of components that the
    sample lacks have one list.
    """
    lists = lists if lists is not None else fit_lists(among, key, vector)
    sent = among.sparkSession.sparkContext.broadcast(lists)

    def dealt(every: bool):
        return lambda batches: listed(batches, sent.value, every)

    schema = "id long, vector array<double>, dims int, of long"
    q = _packed(usable(asked, key, vector).mapInPandas(dealt(True), schema), "of").select("dims", "place", F.col("ids").alias("q_ids"), F.col("unit").alias("q_unit"))
    d = _packed(usable(among, key, vector).mapInPandas(dealt(False), schema), "of")
    return _best(q.hint("shuffle_hash").join(d, ["dims", "place"]))
