"""SimHash fingerprints, linked through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import materialize, whole_runs
from quern.llm.components import components, local_labels
from quern.operators.joins import lookup_join, salted_join

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
#: Runs of more fingerprints than this are linked by looking up every mask of up to RADIUS bits, not by pairs.
PAIRWISE = 1024


def shingle_hashes(text: str | None, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles in order, repeats included, 65,536 at most at once; A-Z are lowered.

    A text of fewer words than a shingle is one shingle; one without words (or null) has none.
    """
    words = text.encode().lower().split() if text else []
    last = max(1, len(words) - width + 1) if words else 0
    for start in range(0, last, 65_536):
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(start, min(last, start + 65_536))], dtype="<u8")


def fold(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes: a bit is 1 if set in over half of them; 0 if there are none."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for hashes in parts:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Repeated shingles count as often as they occur; 0 for a text without words (or null)."""
    return fold(shingle_hashes(text, width))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; for any ``radius`` positions some mask leaves all of them out.

    Position i has the vector i mod (2^(radius+1) - 1) + 1 over GF(2). The mask of a vector v other than 0 keeps
    the positions whose vector has an odd product with v. Vectors of ``radius`` positions span at most radius of
    the radius + 1 dimensions, so some v is orthogonal to all of them.
    """
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Other columns are left out."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fp = np.array([fingerprint(x) for x in rows["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": rows["id"], "fp": fp})

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInPandas(of, "id long, fp long")


def _links_in_run(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect all of the distinct, sorted fps that differ in up to radius bits."""
    a, b = [], []
    if len(fps) <= PAIRWISE:
        for d in range(1, len(fps)):
            hit = np.flatnonzero(np.bitwise_count(fps[:-d] ^ fps[d:]) <= radius)
            a.append(hit)
            b.append(hit + d)
    else:
        same = int(np.bitwise_and.reduce(fps) | ~np.bitwise_or.reduce(fps)) & (2**BITS - 1)
        free = [1 << i for i in range(BITS) if not same >> i & 1]
        flips = {0}
        for _ in range(radius):
            flips |= {x ^ f for x in flips for f in free}
        for x in flips - {0}:
            other = fps ^ np.uint64(x)
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = np.flatnonzero((fps[at] == other) & (at > np.arange(len(fps))))
            a.append(hit)
            b.append(at[hit])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that connect exactly those which radius or fewer bits separate.

    Every fingerprint goes to one table per covering mask, under its masked bits. A bucket gets its members
    sorted and is worked through as a stream. It gives a star for each group of linked members, never its
    pairs. Copies are gone before (fingerprints are distinct), so a bucket has at most 2^(bits left out) members.
    """
    masks = covering_masks(radius)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, ["t", "key"]):
            run = (rows["t"].to_numpy()[1:] != rows["t"].to_numpy()[:-1]) | (rows["key"].to_numpy()[1:] != rows["key"].to_numpy()[:-1])
            starts = np.flatnonzero(np.r_[True, run])
            sizes = np.diff(np.r_[starts, len(rows)])
            fp = rows["fp"].to_numpy().view(np.uint64)
            a, b = [], []
            small = np.repeat(sizes <= PAIRWISE, sizes)
            group = np.repeat(np.arange(len(starts)), sizes)
            left = np.flatnonzero(small & np.repeat(sizes > 1, sizes))
            for d in range(1, PAIRWISE):
                left = left[left + d < len(rows)]
                left = left[group[left] == group[left + d]]
                if not len(left):
                    break
                hit = left[np.bitwise_count(fp[left] ^ fp[left + d]) <= radius]
                a.append(hit)
                b.append(hit + d)
            for i in np.flatnonzero(sizes > PAIRWISE):
                order = np.argsort(fp[starts[i] : starts[i] + sizes[i]]) + starts[i]
                x, y = _links_in_run(fp[order], radius)
                a.append(order[x])
                b.append(order[y])
            if a and sum(map(len, a)):
                label = local_labels(np.concatenate(a), np.concatenate(b), len(rows))
                moved = np.flatnonzero(label != np.arange(len(rows)))
                yield pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[label[moved]].view(np.int64)})

    dealt = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    dealt = dealt.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return dealt.mapInPandas(of, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links between fingerprints that differ in up to radius
    bits; equal fingerprints are linked. Null and wordless texts have fingerprint 0, which links like any other.
    Rows that repeat are kept; a null doc_id is never a component's smallest unless all of it are null. Empty in,
    empty out. Extra columns are left out. Large groups of equal fingerprints are spread over many tasks.
    """
    found = materialize(with_fingerprints(docs))
    distinct = found.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")
    rooted = materialize(distinct.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = salted_join(found, rooted.join(named, "root").select("fp", "component_id"), "fp")
    return told.select(F.col("id").alias("doc_id"), "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_each(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows with a null doc_id stay.

    groups (doc_id, component_id) are those of :func:`near_duplicates` unless others are given.
    """
    groups = near_duplicates(docs) if groups is None else groups
    first = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return lookup_join(docs, materialize(first), "doc_id", "left_anti").select(*docs.columns)
