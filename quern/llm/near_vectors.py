"""Near-duplicate embeddings by collisions in random one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import materialize, whole_runs
from quern.llm.components import components, local_labels

LEAST = 0.95
#: A pair at the least cosine is in a window of some sorted projection with this chance, and then passes the count with COUNTED.
RECALL = 0.985
COUNTED = 0.999
#: Projections whose windows are counted for a pair, and half a window in standard deviations of the gap at LEAST.
COUNT_PROJECTIONS = 64
HALF_WINDOW = 2.0
#: Members of a cell that meet in one block; larger cells are cut into blocks, every two of which meet.
BLOCK = 2048
#: Pairs of windows that are counted at once.
PAIRS = 50_000
SEED = 42


def plan(n: int, least: float = LEAST, recall: float = RECALL, bits: int | None = None) -> tuple[int, int]:
    """(bits, tables) for n vectors: the signs that make a table's cells, and how many tables there are.

    Each table sorts one projection within cells of vectors that agree in the signs of ``bits`` other projections.
    By default there are enough of them that a cell holds 1/16 unrelated vectors on average. There are enough tables
    for the recall at the least cosine. With 0 bits the projections are sorted over all vectors, the plain
    method, whose work is quadratic.
    """
    if bits is None:
        bits = min(60, max(8, math.ceil(math.log2(max(n, 2))) + 4))
    together = (1 - math.acos(least) / math.pi) ** bits * math.erf(HALF_WINDOW / math.sqrt(2))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - together))


def least_count(m: int = COUNT_PROJECTIONS, half: float = HALF_WINDOW, kept: float = COUNTED) -> int:
    """The largest count that a pair at the least cosine reaches with chance ``kept`` in m windows."""
    p = math.erf(half / math.sqrt(2))
    reached = 0.0
    for count in range(m, -1, -1):
        reached += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if reached >= kept:
            return count
    return 0


@lru_cache(maxsize=4)
def _directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, n))


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflows nor vanishes when squared
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _project(unit: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The projections whose windows are counted, and each vector's cell in every table."""
    found = unit @ _directions(unit.shape[1], COUNT_PROJECTIONS + bits * tables)
    signs = (found[:, COUNT_PROJECTIONS:] > 0).reshape(len(unit), tables, bits)
    return found[:, :COUNT_PROJECTIONS], (signs * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _window_pairs(run: np.ndarray, value: np.ndarray, half: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of all pairs of one run whose values are at most ``half`` apart, about PAIRS at a time.

    Each run's values are sorted; the window of a position reaches ``half`` to both sides, and b lies in a's upper half.
    """
    order = np.lexsort((value, run))
    low = value.min()
    axis = run[order] * (value.max() - low + half + 1) + (value[order] - low)
    wide = np.searchsorted(axis, axis + half * (1 + 1e-9), side="right") - np.arange(len(axis)) - 1
    done = np.cumsum(wide)
    start = 0
    while start < len(axis):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + PAIRS, side="right")))
        n = wide[start:stop]
        first = np.repeat(np.arange(start, stop), n)
        if len(first):
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            yield order[first], order[second]
        start = stop


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors that can link: with an id, and neither null, zero, nor with null or non-finite components."""
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(~odd & F.exists("vec", lambda x: x != 0))


def linked_in_windows(classes: DataFrame, bits: int, tables: int, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """classes (rep, vec, copies) of different vectors -> (rep, links, root), maybe several rows a rep.

    links counts the vectors (with their copies) that a rep is linked with in this row; all rows of a rep together
    count each pair once. root is a rep of the same component. Only keys are shuffled for cells of one vector.
    In a cell the table's projection is sorted, and each vector meets those in the window around it. For such a
    pair the windows of all COUNT_PROJECTIONS projections that hold both are counted; pairs with enough of them
    are verified by their cosine in double precision. A pair counts in the first table whose window has it.
    """

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, part in rows.groupby(rows["vec"].map(len)):
                for i in range(0, len(part), 4096):
                    some = part.iloc[i : i + 4096]
                    _, found = _project(_unit(some["vec"]), bits, tables)
                    yield pd.DataFrame(
                        {"dim": dim, "t": np.tile(np.arange(tables), len(some)), "key": found.ravel(), "rep": np.repeat(some["rep"].to_numpy(), tables)}
                    )

    enough = least_count()
    half = HALF_WINDOW * math.sqrt(2 - 2 * least)
    sorted_by = np.arange(tables) % COUNT_PROJECTIONS

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = ["dim", "t", "key", "low", "high"]
        for all_rows in whole_runs(batches, by):
            for _, rows in all_rows.groupby("dim"):
                run = rows[by].ne(rows[by].shift()).any(axis=1).cumsum().to_numpy()
                unit = _unit(rows["vec"])
                projected, keys = _project(unit, bits, tables)
                rep, copies, t = (rows[c].to_numpy() for c in ("rep", "copies", "t"))
                part, crossing = rows["part"].to_numpy(), (rows["low"] != rows["high"]).to_numpy()
                ids, at = np.unique(rep, return_inverse=True)
                each = np.zeros(len(ids), np.int64)
                each[at] = copies
                links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for a, b in _window_pairs(run, projected[np.arange(len(rows)), sorted_by[t]], half):
                    met = ~crossing[a] | (part[a] != part[b])
                    a, b = a[met], b[met]
                    passed = (np.abs(projected[a] - projected[b]) <= half).sum(axis=1) >= enough
                    a, b = a[passed], b[passed]
                    near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
                    a, b = a[near], b[near]
                    meet = (keys[a] == keys[b]) & (np.abs(projected[a][:, sorted_by] - projected[b][:, sorted_by]) <= half)
                    first = meet.argmax(axis=1) == t[a]
                    a, b = at[a[first]], at[b[first]]
                    np.add.at(links, a, each[b])
                    np.add.at(links, b, each[a])
                    if len(a):
                        label = local_labels(np.append(a, np.arange(len(ids))), np.append(b, label), len(ids))
                if links.any():
                    yield pd.DataFrame({"rep": ids, "links": links, "root": ids[label]})[links > 0]

    keyed = materialize(classes.select("rep", "vec").mapInPandas(key, "dim int, t int, key long, rep long"))
    shared = keyed.groupBy("dim", "t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block)
    met = keyed.join(shared, ["dim", "t", "key"]).withColumn("parts", parts.cast("long"))
    met = met.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    met = met.select("dim", "t", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "rep")
    dealt = met.join(classes, "rep").repartition("dim", "t", "key", "low", "high").sortWithinPartitions("dim", "t", "key", "low", "high")
    return dealt.mapInPandas(link, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, recall: float = RECALL, block: int = BLOCK, bits: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    Two vectors are linked if their cosine is ``least`` or more and the window of a sorted projection brings them together;
    equal vectors always are. Null and zero vectors, such with null or non-finite components, and null ids link with
    nothing; so do vectors of different lengths with each other. Rows that repeat both id and vector count as one vector.
    Empty in, empty out; extra columns are left out.

    A window of one projection that holds most of a vector's near ones also holds a quarter or more of all
    others, so over the whole table (``bits`` = 0) the pairs to count are quadratic; by default projections are
    sorted within cells, see :func:`plan`.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    name = [F.xxhash64("vec").alias("x"), F.xxhash64(F.lit(1), "vec").alias("y")]
    copies = _usable(rows).withColumns({"x": name[0], "y": name[1]}).groupBy("x", "y")
    classes = materialize(copies.agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("vec").alias("vec")))
    bits, tables = plan(classes.count(), least, recall, bits)
    found = materialize(linked_in_windows(classes.select("rep", "vec", "copies"), bits, tables, least, block))
    root = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    summed = found.groupBy("rep").agg(F.sum("links").alias("links")).join(root, "rep", "left")
    told = classes.select("x", "y", "rep", "copies").join(summed, "rep", "left")
    usable = _usable(rows).select("vec_id", *name).distinct()
    linked = usable.join(told, ["x", "y"]).select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    # an id with several different vectors is in one component and has the links of all of them
    linked = linked.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
