"""Substring deduplication: windows of words that occur before, found exactly through super-k-mers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import give_back, materialize, whole_runs

WINDOW = 20
#: Words of a minimiser; a window has WINDOW - MINIMISER + 1 of them and takes the one of the least hash.
MINIMISER = 4
#: Minimisers of more shared runs than this are dealt out by single windows, so no place holds more than a few MB.
HOT_RUNS = 5_000
#: Lists of hot minimisers up to this length (2 MB) are broadcast; longer ones are joined.
MOST_HOT = 200_000
#: Runs that a task sorts at once, and packed runs that it remembers.
LOCAL_RUNS = 1_000_000
REMEMBERED = 200_000

_LAST_ID = 2**63 - 1


def _spread(h: Column) -> Column:
    """What rows without an id have beside d, so that they are not one key: a part of their hash; 0 for other rows.

    It is never null, or else a filter on one side keeps the two joins from sharing a shuffle of the texts.
    """
    return F.when(F.col("d") == _LAST_ID, h.bitwiseAND(F.lit(2**31 - 1))).otherwise(F.lit(0).cast("long")).cast("int")


class Runs(NamedTuple):
    """Super-k-mers of one text: consecutive windows whose minimiser is the same occurrence of a gram.

    Equal windows have their minimiser at the same offset, so equal windows at two places are in two runs.
    """

    minimiser: np.ndarray  # int64
    start: np.ndarray  # first window
    count: np.ndarray  # windows


def super_kmers(words: list[bytes], window: int = WINDOW, width: int = MINIMISER) -> Runs:
    """The runs of a text, in order; none if it has fewer words than a window."""
    n = len(words) - window + 1
    if n < 1:
        return Runs(*(np.empty(0, np.int64),) * 3)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    m = len(words) - width + 1
    gram = hashes[:m].copy()
    for k in range(1, width):
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
    gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    gram ^= gram >> np.uint64(32)
    spread = window - width + 1
    best, reach = np.arange(m), 1  # the leftmost least of the ``reach`` grams from each on, by doubling
    while reach < spread:
        step = min(reach, spread - reach)
        here, there = best[:-step], best[step:]
        best = np.where(gram[there] < gram[here], there, here)
        reach += step
    start = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    return Runs(gram[best[start]].view(np.int64), start, np.diff(np.append(start, n)))


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if isinstance(text, str) else []


def shared_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, spread, start, minimiser) of the runs whose minimiser occurs in another run, of docs (d, spread, text).

    What occurs twice among LOCAL_RUNS runs of a task is known to be shared; only one run of each minimiser goes from
    these to the minimiser's place, so the most common of them meets a row for so many runs there.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for rows in batches:
            for d, spread, text in zip(rows["d"], rows["spread"], rows["text"], strict=True):
                runs = super_kmers(_words(text), window)
                n = len(runs.start)
                if n:
                    found.append((runs.minimiser, np.full(n, d, np.int64), np.full(n, spread, np.int32), runs.start.astype(np.int32)))
                    held += n
                if held >= LOCAL_RUNS:
                    yield from marked(found)
                    held = 0
        if found:
            yield from marked(found)
        give_back()

    def marked(found: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        value, d, spread, start = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        order = np.argsort(value, kind="stable")
        value, d, spread, start = value[order], d[order], spread[order], start[order]
        first = np.append(True, value[1:] != value[:-1])
        last = np.append(first[1:], True)
        for i in range(0, len(value), 50_000):
            part = slice(i, i + 50_000)
            one, end = first[part], last[part]
            # 0: shared, 1: not shared here, 2: only says that it is shared here
            here = pd.DataFrame({"minimiser": value[part], "d": d[part], "spread": spread[part], "start": start[part], "kind": np.where(one & end, 1, 0).astype(np.int8)})
            here["place"] = np.where(one & end, here["minimiser"], here["minimiser"] * 31 + here["d"] * 0x9E3779B1 + here["start"])
            yield here
            told = here[one & ~end].assign(kind=np.int8(2))
            yield told.assign(place=told["minimiser"])

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, ["place"]):
            alone = rows["kind"] == 1
            with_others = rows[rows["kind"] > 0].duplicated("minimiser", keep=False).reindex(rows.index, fill_value=False)
            yield rows.loc[(rows["kind"] == 0) | (alone & with_others), ["d", "spread", "start", "minimiser"]]

    schema = "minimiser long, d long, spread int, start int, kind byte, place long"
    dealt = docs.select("d", "spread", "text").mapInPandas(local, schema).repartition("place").sortWithinPartitions("place")
    return dealt.mapInPandas(told, "d long, spread int, start int, minimiser long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(d, h, start, count): windows start..start + count - 1 of the text (d, h) whose words start a window earlier.

    docs has d, spread, text and rest; h is the hash of the last two, earlier means smaller (d, start). Shared runs go to their minimiser's
    place as one packed string, earliest first; there each window is looked up among those already seen. A run
    that a task remembers, word for word, needs no trip. Runs of a hot minimiser (more than hot_runs of them) go as
    single windows to the place of the window instead, and the same step counts them. So a task holds REMEMBERED
    names, LOCAL_RUNS runs or the windows of hot_runs runs at most, whatever the corpus.
    """
    shared = materialize(shared_runs(docs, window))
    per_minimiser = shared.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(per_minimiser.where(F.col("n") > hot_runs).select("minimiser", F.col("minimiser").alias("hot")))
    marked = shared.join(F.broadcast(hot) if hot.limit(MOST_HOT + 1).count() <= MOST_HOT else hot, "minimiser", "left")
    per_text = marked.groupBy("d", "spread").agg(F.collect_set("start").alias("starts"), F.collect_set("hot").alias("hot"))
    schema = "place long, d long, h long, start int, count int, packed binary"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, tuple[int, int]] = {}
        for rows in batches:
            out: list[tuple] = []
            for d, h, text, starts, hot in zip(*(rows[c] for c in ("d", "h", "text", "starts", "hot")), strict=True):
                words = _words(text)
                runs = super_kmers(words, window)
                chosen = np.isin(runs.start, starts)
                is_hot = np.isin(runs.minimiser, hot)
                for value, at, count, split in zip(*(x[chosen].tolist() for x in (*runs, is_hot)), strict=True):
                    for i, k in [(at + j, 1) for j in range(count)] if split else [(at, count)]:
                        span = b" ".join(words[i : i + k + window - 1])
                        name = xxhash.xxh3_128_digest(span)
                        place = int.from_bytes(name[:8], "little", signed=True) if split else value
                        here, first = (d, i), seen.get(name)
                        if first is not None and first < here:
                            spread = int.from_bytes(name[8:], "little", signed=True) ^ d ^ i
                            out.append((spread, d, h, i, k, None))
                        else:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[name] = here
                            out.append((place, d, h, i, k, span))
            if out:
                yield pd.DataFrame(out, columns=["place", "d", "h", "start", "count", "packed"])
        seen.clear()
        out = rows = None
        give_back()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, seen = None, {}
        for rows in batches:
            out: list[tuple] = []
            for key, d, h, at, n, packed in zip(*(rows[c] for c in ("place", "d", "h", "start", "count", "packed")), strict=True):
                if packed is None:
                    out.append((d, h, at, n))
                    continue
                if key != place:
                    place, seen = key, {}
                words = packed.split()
                repeated = []
                for i in range(n):
                    name = b" ".join(words[i : i + window])
                    here = (d, at + i)
                    repeated.append(seen.setdefault(name, here) < here)
                i = 0
                while i < n:
                    j = i
                    while j < n and repeated[j] == repeated[i]:
                        j += 1
                    if repeated[i]:
                        out.append((d, h, at + i, j - i))
                    i = j
            if out:
                yield pd.DataFrame(out, columns=["d", "h", "start", "count"])
        out = rows = seen = None
        give_back()

    with_runs = docs.join(per_text, ["d", "spread"]).select("d", "spread", F.xxhash64("text", "rest").alias("h"), "text", "starts", "hot")
    # sorted (as a merge join leaves it), so that a task run again gives the same rows
    dealt = with_runs.sortWithinPartitions("d", "spread").mapInPandas(pack, schema).repartition("place").sortWithinPartitions("place", "d", "start")
    return dealt.mapInPandas(count, "d long, h long, start int, count int")


def _kept(words: list[bytes], found: np.ndarray, window: int) -> list[bytes]:
    """The words that no window of ``found`` (rows of start, count) covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0], 1)
    np.add.at(edge, found[:, 0] + found[:, 1] + window - 1, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot_runs: int = HOT_RUNS) -> DataFrame:
    """The columns of docs, with text cut, and n_words and n_removed (same-named columns are replaced).

    A word goes if a window of ``window`` words covers it whose words also start a window earlier: in a smaller
    doc_id, or before in the same text. Windows are judged on the input. In a text that loses a word the rest is
    joined by single spaces; other texts stay as they are. Null texts stay null with 0 words. Rows of one doc_id
    are not earlier than each other at the same start; null doc_ids come after all others. Empty in, empty out.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    rest = [c for c in names if c != "text"]
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))
    # Both joins below take the same columns of docs by the same key, so that the texts are shuffled once.
    texts = docs.select(d.alias("d"), "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    texts = texts.withColumn("spread", _spread(F.xxhash64("text", "rest")))
    found = repeated_windows(texts, window, hot_runs)
    found = found.groupBy("d", _spread(F.col("h")).alias("spread")).agg(F.collect_set(F.struct("h", "start", "count")).alias("found"))

    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, hashes, lists in batches:
            out = []
            for text, h, spans in zip(texts, hashes, lists, strict=True):
                words = _words(text)
                own = np.array([(x["start"], x["count"]) for x in spans if x["h"] == h], dtype=np.int64).reshape(-1, 2) if spans is not None else ()
                if len(own):
                    kept = _kept(words, own, window)
                    out.append((b" ".join(kept).decode(), len(words), len(words) - len(kept)))
                else:
                    out.append((text, len(words), 0))
            yield pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    told = F.pandas_udf(cut, "text string, n_words long, n_removed long")
    joined = texts.join(found, ["d", "spread"], "left").withColumn("cut", told("text", F.xxhash64("text", "rest"), "found"))
    return joined.select(*[F.col("cut.text") if c == "text" else F.col(f"rest.`{c}`") for c in names], "cut.n_words", "cut.n_removed")
