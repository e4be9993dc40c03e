"""Hashed n-gram counts of whole texts, a block of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of text counted at once; longer texts are counted in parts.
PART = 2_000_000
BLOCK_ROWS = 128
#: Distances to the n-gram before of the same bytes are told apart by their power of two, up to a reach.
DISTANCES = 14
REACH = 2**DISTANCES


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, encoded texts) for blocks of up to BLOCK_ROWS texts and about PART bytes."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if held and (len(held) == BLOCK_ROWS or size + len(data) > PART):
            yield start, held
            start, held, size = i, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield start, held


def ngram_counts(texts: list[bytes], dims: int, n: int = 3) -> np.ndarray:
    """A row per text: how often its byte n-grams fall on each of dims (a power of two) hash values."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    counts = np.zeros(len(texts) * dims, dtype=np.float32)
    shift = np.uint32(33 - dims.bit_length())
    for at in range(0, len(data) - n + 1, PART):
        part = data[at : at + PART + n - 1].astype(np.uint32)
        m = len(part) - n + 1
        code = part[:m] * np.uint32(0x9E3779B1)
        for k in range(1, n):
            code += part[k : k + m]
            code *= np.uint32(0x9E3779B1)
        first, last = owner[at : at + m], owner[at + n - 1 : at + n - 1 + m]
        cell = first * np.int64(dims) + (code >> shift)
        counts += np.bincount(cell[first == last], minlength=len(counts))
    return counts.reshape(len(texts), dims)


def recurrences(texts: list[bytes], n: int = 4) -> np.ndarray:
    """A row per text: how often a byte n-gram was last there 1, 2 to 3, 4 to 7, ... bytes before, and how often not within REACH."""
    counts = np.zeros((len(texts), DISTANCES + 1), dtype=np.float32)
    for row, text in zip(counts, texts, strict=True):
        for at in range(0, len(text) - n + 1, PART):
            start = max(0, at - REACH)
            part = np.frombuffer(text, dtype=np.uint8)[start : at + PART + n - 1].astype(np.uint64)
            m = len(part) - n + 1
            code = np.zeros(m, dtype=np.uint64)
            for k in range(n):
                code = code << np.uint64(8) | part[k : k + m]
            code = np.sort(code << np.uint64(32) | np.arange(m, dtype=np.uint64))
            place = (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
            distance = np.diff(place)
            near = (code[1:] >> np.uint64(32) == code[:-1] >> np.uint64(32)) & (distance < REACH) & (place[1:] >= at - start)
            row[:DISTANCES] += np.bincount(np.log2(distance[near]).astype(np.int64), minlength=DISTANCES)
            row[DISTANCES] += m - (at - start) - near.sum()
    return counts


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows of zeros stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def hash_digits(seed: str, column: str = "doc_id") -> Column:
    """The start of an id's digest; a null id counts as empty text."""
    return F.substring(F.md5(F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(seed))), 1, 8)


def hash_below(share: Column, seed: str, column: str = "doc_id") -> Column:
    """True for a share of the ids that a hash decides."""
    return F.conv(hash_digits(seed, column), 16, 10).cast("long") / float(2**32) < share


def bounded_sample(rows: DataFrame, by: str, per_value: int, most: int, seed: str) -> DataFrame:
    """About per_value rows for each value of ``by``, by a hash of doc_id, and about ``most`` in all.

    Of more than ``most`` values the most frequent count (the first by name of equally frequent ones). Callers cut
    what they make of the rows to ``most``, in the order of the hash, so that chance cannot overshoot.
    """
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), by)
    shares = {r[by]: r["_n"] for r in counted.limit(most).collect()}
    if not shares:
        return rows.limit(0)
    each = min(float(per_value), 0.9 * most / len(shares))
    sizes = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    return rows.where(hash_below(F.lit(each) / sizes[F.col(by)], seed))
