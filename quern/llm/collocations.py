"""Collocations from streams of counts: one in prefix order, one in suffix order, read side by side."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from quern.llm.bpe import own_texts, slices
from quern.llm.common import give_back, materialize, scratch

#: Marks that no phrase goes across; words are what spaces and tabs leave between them.
MARKS = r"[.,;:!?\x0A-\x0D]+"
LEAST, LONGEST, TOP = 100, 5, 2000
NO_LANG = "und"
#: Bytes of text whose phrases are counted together before they leave Python.
TEXT_BYTES = 8_000_000
#: Bits of a filter of frequent phrases (16 MB, whatever the corpus). It only spares work: what it lets through wrongly is counted and dropped.
FILTER_BITS = 1 << 27
#: Counted phrases in a range of an order, and the most ranges there are.
RANGE_ROWS = 5_000
MOST_RANGES = 1_024


@dataclass
class _Words:
    """Positions of a slice of texts: the number of a (lang, word), or -1 for a mark; no word follows another text's."""

    unit: np.ndarray
    doc: np.ndarray
    langs: pa.Array
    words: pa.Array
    counts: np.ndarray


def _read_words(part: pa.RecordBatch) -> _Words:
    texts = pc.replace_substring_regex(pc.ascii_lower(own_texts(part.column("text"))), MARKS, " . ")
    split = pc.ascii_split_whitespace(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(split.offsets.to_numpy()))
    coded = split.values.dictionary_encode()
    place, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[place] if len(words) else np.zeros(0, bool)
    place, doc = place[full], doc[full]
    mark = pc.equal(words, ".").to_numpy(zero_copy_only=False)[place] if len(place) else np.zeros(0, bool)
    lang = pc.fill_null(part.column("lang").cast(pa.large_string()), NO_LANG).dictionary_encode()
    key = lang.indices.to_numpy().astype(np.int64)[doc] * max(1, len(words)) + place
    found, number, counts = np.unique(key[~mark], return_inverse=True, return_counts=True)
    unit = np.full(len(key), -1, np.int64)
    unit[~mark] = number
    which, at = np.divmod(found, max(1, len(words)))
    return _Words(unit, doc, lang.dictionary.take(pa.array(which)), words.take(pa.array(at)), counts)


def _rows(langs: pa.Array, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.cast(pa.string()), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "n"])


def _single_words(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Counts of words, and those of all words of a lang under the phrase that is empty."""
    read = _read_words(part)
    yield _rows(read.langs, read.words, read.counts)
    total = pa.table({"lang": read.langs, "n": read.counts}).group_by("lang").aggregate([("n", "sum")]).combine_chunks()
    for batch in total.to_batches():
        yield _rows(batch.column("lang"), pa.array([""] * len(batch)), batch.column("n_sum").to_numpy())


def _passes(bits: np.ndarray, langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Which phrases a filter lets through; the hash is that of Spark's xxhash64 over (lang, phrase)."""
    seeds = {x: xxhash.xxh64_intdigest(x.encode(), 42) for x in pc.unique(langs).to_pylist()}
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, seeds[x]) for x, p in zip(langs.to_pylist(), phrases.to_pylist(), strict=True)), np.uint64, len(langs))
    at = hashes % np.uint64(FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _spell(read: _Words, starts: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    units = [read.unit[starts + k] for k in range(n)]
    return read.langs.take(pa.array(units[0])), pc.binary_join_element_wise(*[read.words.take(pa.array(u)) for u in units], pa.scalar(" ", read.words.type))


def _longer_phrases(part: pa.RecordBatch, filters: list[np.ndarray], longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of pairs whose words pass the first filter; with a second, of phrases of 3 to ``longest`` words whose pairs pass that."""
    read = _read_words(part)
    frequent = np.append(_passes(filters[0], read.langs, read.words), False)
    near = frequent[read.unit[:-1]] & frequent[read.unit[1:]] & (read.doc[:-1] == read.doc[1:])
    starts = np.flatnonzero(near)
    wide = np.int64(max(1, len(read.words)))
    _, first, number, counts = np.unique(read.unit[starts] * wide + read.unit[starts + 1], return_index=True, return_inverse=True, return_counts=True)
    langs, phrases = _spell(read, starts[first], 2)
    if len(filters) == 1:
        yield _rows(langs, phrases, counts)
        return
    pair = np.zeros(len(read.unit) + longest, bool)
    pair[starts] = _passes(filters[1], langs, phrases)[number]
    keep = pair[starts]
    starts, number = starts[keep], number[keep]
    for n in range(3, longest + 1):
        keep = pair[starts + n - 2]
        starts, number = starts[keep], number[keep]
        _, first, number, counts = np.unique(number * wide + read.unit[starts + n - 1], return_index=True, return_inverse=True, return_counts=True)
        yield _rows(*_spell(read, starts[first], n), counts)


def _count(docs: DataFrame, of: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(lang, phrase, a): counts summed within tasks, then over the corpus."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                yield from of(part)
            give_back()

    return docs.select("lang", "text").mapInArrow(each, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def frequent_filter(counted: DataFrame) -> np.ndarray:
    """A bit for the hash of each (lang, phrase), FILTER_BITS in all: at most 4,096 pieces of 4 KB come to the driver."""
    at = F.pmod(F.xxhash64("lang", "phrase"), F.lit(FILTER_BITS)) + 1
    pieces = counted.select(F.bitmap_bucket_number(at).alias("piece"), F.bitmap_bit_position(at).alias("bit"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for piece, packed in pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(packed, np.uint8)
    return bits


def phrase_counts(docs: DataFrame, put: Callable[[DataFrame], DataFrame], least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, a) of all phrases of 1 to ``longest`` words that occur ``least`` times, (lang, n) of all words).

    Three passes over the texts: words, pairs of frequent words, longer phrases all of whose pairs are frequent.
    ``put`` writes a table and reads it back.
    """
    spark = docs.sparkSession
    counted = put(_count(docs, _single_words).where((F.col("a") >= least) | (F.col("phrase") == "")))
    totals = put(counted.where("phrase = ''").select("lang", F.col("a").alias("n")))
    tables = [counted.where("phrase <> ''")]
    filters = []
    for n in range(2, min(longest, 3) + 1):
        filters.append(frequent_filter(tables[-1]))
        sent = spark.sparkContext.broadcast(list(filters))
        tables.append(put(_count(docs, lambda part, sent=sent: _longer_phrases(part, sent.value, longest)).where(F.col("a") >= least)))
    found = tables[0]
    for more in tables[1:]:
        found = found.unionByName(more)
    return found, totals


@dataclass
class _Order:
    """An order of phrases by words from the first on, or from the last back, cut into ranges.

    Range i holds what is above bounds[i - 1], up to bounds[i]. ``heads`` has the counts of the beginnings of each
    bound, which are just the beginnings that phrases of a range have in ranges before. At most MOST_RANGES bounds.
    """

    backwards: bool
    bounds: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    heads: list[list[int]] = field(default_factory=list)

    def words(self, phrase: str) -> tuple[str, ...]:
        return tuple(phrase.split(" ")[:: -1 if self.backwards else 1])

    def spell(self, words: tuple[str, ...]) -> str:
        return " ".join(words[:: -1 if self.backwards else 1])

    def ranges(self, rows: pd.DataFrame) -> list[int]:
        return [bisect_left(self.bounds, (x, self.words(p))) for x, p in zip(rows["lang"], rows["phrase"], strict=True)]


def _order(counted: DataFrame, rows: int, backwards: bool) -> _Order:
    """The bounds are quantiles of about 20 phrases a range that a hash picks."""
    ranges = max(1, min(MOST_RANGES, math.ceil(rows / RANGE_ROWS)))
    order = _Order(backwards)
    if ranges == 1:
        return order
    share = min(1.0, 20 * ranges / rows)
    picked = counted.where(F.pmod(F.xxhash64(F.lit("order"), "lang", "phrase"), F.lit(1_000_003)) < int(share * 1_000_003)).select("lang", "phrase")
    keys = sorted((r["lang"], order.words(r["phrase"])) for r in picked.collect())
    order.bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    if order.bounds:
        wanted = {(x, order.spell(w[:k])) for x, w in order.bounds for k in range(1, len(w) + 1)}
        asked = counted.sparkSession.createDataFrame(sorted(wanted), "lang string, phrase string")
        count_of = {(r["lang"], r["phrase"]): r["a"] for r in counted.join(F.broadcast(asked), ["lang", "phrase"]).collect()}
        order.heads = [[count_of[x, order.spell(w[:k])] for k in range(1, len(w) + 1)] for x, w in order.bounds]
    return order


@dataclass
class _Open:
    lang: str
    words: tuple[str, ...]
    a: int
    row: tuple | None
    shorter: list[int]
    held: bool = False


def _walk(order: _Order, number: int, rows: Iterator[tuple], share: int) -> Iterator[_Open]:
    """Rows (lang, phrase, a, ...) of a range in order; each comes back with the counts of its beginnings, once all that begin with it have passed.

    ``held`` tells whether one word more is as frequent (share in 100). The beginnings in earlier ranges come, too, without a row.
    """
    lang, words = order.bounds[number - 1] if number else ("", ())
    open_: list[_Open] = []
    for k, a in enumerate(order.heads[number - 1] if number else [], 1):
        open_.append(_Open(lang, words[:k], a, None, []))
    for row in rows:
        lang, words, a = row[0], order.words(row[1]), row[2]
        while open_ and not (open_[-1].lang == lang and open_[-1].words == words[: len(open_[-1].words)]):
            yield open_.pop()
        if open_ and 100 * a >= share * open_[-1].a:
            open_[-1].held = True
        open_.append(_Open(lang, words, a, row, [x.a for x in open_]))
    while open_:
        yield open_.pop()


def _pass(rows: DataFrame, order: _Order, share: int, told: Callable[[_Open, int], tuple], schema: str) -> DataFrame:
    """Reads rows (number, lang, phrase, ...) in order, a range a task, and makes of each what ``told`` says."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def ranges() -> Iterator[tuple[int, Iterator[tuple]]]:
            """The rows of each range; a range is read to its end before the next."""
            every = (r for batch in batches for r in batch.drop(columns=["_words"]).itertuples(index=False, name=None))
            ahead = next(every, None)

            def of(number: int) -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and ahead[0] == number:
                    yield ahead[1:]
                    ahead = next(every, None)

            while ahead is not None:
                yield ahead[0], of(ahead[0])

        for number, found in ranges():
            for x in _walk(order, number, found, share):
                if x.row is not None or x.held:
                    out.append(told(x, number))
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    words = F.split("phrase", " ", -1)
    sorted_ = rows.withColumn("_words", F.reverse(words) if order.backwards else words)
    sorted_ = sorted_.repartitionById(len(order.bounds) + 1, "number").sortWithinPartitions("number", "lang", "_words")
    return sorted_.mapInPandas(each, schema)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = 100, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each lang of documents (lang, text).

    Phrases of 2 to ``longest`` words that occur ``least`` times, a, are cut where 1000 * a * n / (l * r), floored, is least:
    l and r are the counts of both parts and n that of all words of the lang; of equal cuts the first counts. A phrase that stands in a longer
    one, which needs share / 100 of its count, is left out: then already one word more at one of its ends has that count,
    as counts fall with length. Ties go by a, then by the bytes of the phrase.

    Null texts and empty ones have no words, a null lang is NO_LANG, repeated rows count each, and other columns are not read. An empty
    table gives no rows. Counts are summed in tasks before they are shuffled. Both orders are sorted by ranges of
    phrases, so that a first word that many phrases share is spread over tasks; rows of up to five beginnings a range are what tasks get from elsewhere.
    """
    spark = docs.sparkSession
    with scratch(spark) as put:
        counted, totals = phrase_counts(docs, put, least, longest)
        rows = counted.count()
        by_last, by_first = _order(counted, rows, True), _order(counted, rows, False)

        def number(order: _Order) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
            def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for x in batches:
                    yield x.assign(number=order.ranges(x))[["number", "lang", "phrase", "a", "n"]]

            return each

        def from_last(x: _Open, _: int) -> tuple:
            phrase = by_last.spell(x.words)
            at = bisect_left(by_first.bounds, (x.lang, by_first.words(phrase)))
            return at, x.lang, phrase, x.a, x.row[3] if x.row else 0, x.shorter, x.held, x.row is None

        def from_first(x: _Open, _: int) -> tuple:
            if x.row is None:
                return x.lang, by_first.spell(x.words), x.a, 0, 0, 0, 0, True, True
            n, ends, held = x.row[3], x.row[4], x.row[5]
            cuts = [(1000 * x.a * n // (left * int(right)), k, left, int(right)) for k, (left, right) in enumerate(zip(x.shorter, ends[::-1], strict=True))]
            score, _, left, right = min(cuts) if cuts else (0, 0, 0, 0)
            return x.lang, by_first.spell(x.words), x.a, left, right, n, score, x.held or held, False

        numbered = counted.join(totals, "lang").select("lang", "phrase", "a", "n").mapInPandas(number(by_last), "number int, lang string, phrase string, a long, n long")
        ended = put(_pass(numbered, by_last, share, from_last, "number int, lang string, phrase string, a long, n long, ends array<long>, held boolean, apart boolean"))
        begun = _pass(ended.where("NOT apart"), by_first, share, from_first, "lang string, phrase string, a long, l long, r long, n long, score long, held boolean, apart boolean")
        begun = put(begun)
        apart = begun.where("apart").select("lang", "phrase").union(ended.where("apart").select("lang", "phrase"))  # five a range and order at most
        kept = begun.where("NOT apart AND NOT held AND instr(phrase, ' ') > 0").join(F.broadcast(apart), ["lang", "phrase"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
        return materialize(kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))

