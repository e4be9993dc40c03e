"""Byte-level BPE by corpus-level merge replay, and its inverse."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quern.llm.common import give_back

#: No token: ends of words and pairs without a merge.
NONE = np.int32(2**31 - 1)
#: Bytes of text whose new words are replayed together, and words whose ids a task remembers (about 60 bytes each).
REPLAY_CHARS = 4_000_000
REMEMBERED = 300_000
#: White space next to a space; a text without it can be cut at every space before the pattern is applied.
_CLOSE_SPACE = r" [\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]|[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}] "


class Ranks:
    """A rank file: tokens by id, and the rank of every pair of tokens that makes a token."""

    def __init__(self, content: bytes):
        rank_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.size = max(rank_of.values()) + 1
        by_id = [b""] * self.size
        for token, rank in rank_of.items():
            by_id[rank] = token
        self.lengths = np.array([len(x) for x in by_id], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.of_byte = np.array([rank_of[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = sorted(
            (rank_of[left] * self.size + rank_of[right], rank)
            for token, rank in rank_of.items()
            for cut in range(1, len(token))
            if (left := token[:cut]) in rank_of and (right := token[cut:]) in rank_of
        )
        self.keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.ranks = np.array([r for _, r in pairs], dtype=np.int32)
        every = np.arange(256)
        self.of_two_bytes = self.of_pairs(self.of_byte[np.repeat(every, 256)], self.of_byte[np.tile(every, 256)])

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


@lru_cache(maxsize=4)
def read_ranks(content: bytes) -> Ranks:
    return Ranks(content)


def replay_merges(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all the words, one after the other, and where each one's begin (one more entry than words).

    All words are one array of tokens with links to the next and the last. An inverted index leads from the rank
    of a pair to its positions. The least rank of all is merged first, at the leftmost position of every word
    that has it; only the pairs with the neighbours of a merge get new entries. A rank comes back to the heap if
    a word has it again or a merge makes it, so each word sees its merges in just the order it would alone.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(flat)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    ends = np.cumsum(sizes)
    token = np.append(ranks.of_byte[flat], np.int32(-1))
    following = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    following[ends[sizes > 0] - 1] = n
    before[(ends - sizes)[sizes > 0]] = n
    before[n] = following[n] = n
    rank = np.full(n + 1, NONE, dtype=np.int32)
    if n > 1:
        rank[: n - 1] = ranks.of_two_bytes[flat[:-1].astype(np.int32) * 256 + flat[1:]]
        rank[ends[sizes > 0] - 1] = NONE
    index: dict[int, list[np.ndarray]] = {}

    def enter(at: np.ndarray) -> list[int]:
        order = np.argsort(rank[at], kind="stable")
        at = at[order]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        starts = [0, *cuts.tolist(), len(at)]
        new = []
        for r, i, j in zip(rank[at[starts[:-1]]].tolist(), starts[:-1], starts[1:], strict=True):
            if r not in index:
                index[r] = []
                new.append(r)
            index[r].append(at[i:j])
        return new

    open_ = np.flatnonzero(rank != NONE).astype(np.int32)
    heap = enter(open_) if len(open_) else []
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        entries = index.pop(r)
        at = entries[0] if len(entries) == 1 else np.concatenate(entries)
        at = np.unique(at[rank[at] == r])
        if not len(at):
            continue
        owner = word[at]
        leftmost = np.append(True, owner[1:] != owner[:-1])
        if not leftmost.all():
            index[r] = [at[~leftmost]]
            heapq.heappush(heap, r)
            at = at[leftmost]
        gone = following[at]
        after = following[gone]
        token[at] = r
        token[gone] = -1
        rank[gone] = NONE
        following[at] = after
        before[after] = at
        before[n] = n
        left = before[at]
        rank[at] = ranks.of_pairs(token[at], token[after])
        rank[left] = ranks.of_pairs(token[left], token[at])
        rank[n] = NONE
        touched = np.concatenate([at, left])
        touched = touched[rank[touched] != NONE]
        if len(touched):
            for x in enter(touched):
                heapq.heappush(heap, x)
    alive = token[:n] >= 0
    return token[:n][alive], np.append(0, np.cumsum(np.bincount(word[alive], minlength=len(words))))


def gather(starts: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of ragged rows, one row after the other; row i is values[starts[i]:starts[i + 1]]."""
    sizes = starts[rows + 1] - starts[rows]
    shift = np.repeat(starts[rows] - (np.cumsum(sizes) - sizes), sizes)
    return values[shift + np.arange(len(shift))]


def own_texts(texts: pa.Array) -> pa.Array:
    """A copy with null texts empty. Some string kernels misread arrays that are slices of others."""
    return pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))


class Remembered:
    """Ids of the words that a task has met, so that each is encoded once; starts[i]:starts[i + 1] are those of word i.

    Past ``most`` words it starts again with the latest. encode gives the ids of different words, one after the
    other, and where each one's begin.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.starts = pa.array([], pa.large_string()), np.empty(0, np.int32), np.zeros(1, np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each of some different words."""
        if len(self.words) + len(words) > self.most:
            self._forget()
        known = pc.index_in(words, value_set=self.words)
        new = pc.is_null(known)
        fresh = words.filter(new)
        ids, starts = self.encode(fresh)
        place = pc.fill_null(known, 0).to_numpy().astype(np.int64)
        place[new.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(fresh))
        self.words = pa.concat_arrays([self.words, fresh])
        self.starts = np.append(self.starts, self.starts[-1] + starts[1:])
        self.ids = np.append(self.ids, ids)
        return place


def _replay_texts(ranks: Ranks, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, given by their pieces, and where each one's begin; a piece is replayed once for all."""
    found: dict[str, int] = {}
    at = np.array([found.setdefault(x, len(found)) for text in pieces for x in text], dtype=np.int64)
    ids, starts = replay_merges(ranks, [x.encode() for x in found])
    done = np.append(0, np.cumsum((starts[1:] - starts[:-1])[at]))
    return gather(starts, ids, at), done[np.append(0, np.cumsum(np.array([len(x) for x in pieces], dtype=np.int64)))]


def word_encoder(ranks: Ranks, pattern: str) -> Remembered:
    """Encodes words, each with the space before it."""
    cut = regex.compile(pattern).findall
    return Remembered(lambda words: _replay_texts(ranks, [cut(x) for x in words.to_pylist()]), REMEMBERED)


def encode_batch(ranks: Ranks, texts: pa.Array, pattern: str, words: Remembered | None = None) -> Iterator[np.ndarray]:
    """Ids of each text (null: none). Words that ``words`` doesn't remember are replayed together."""
    texts, words = own_texts(texts), words or word_encoder(ranks, pattern)
    close = pc.match_substring_regex(texts, _CLOSE_SPACE).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(texts, " ")
    offsets = split.offsets.to_numpy()
    coded = split.values.dictionary_encode()
    first = np.zeros(len(coded), dtype=np.int64)
    first[offsets[:-1]] = 1
    unit = coded.indices.to_numpy().astype(np.int64) * 2 + first
    place = np.full(2 * len(coded.dictionary), -1, dtype=np.int64)
    for i in np.flatnonzero(~close).tolist():
        place[unit[offsets[i] : offsets[i + 1]]] = 0
    opening, spaced = np.flatnonzero(place[1::2] == 0), np.flatnonzero(place[::2] == 0)
    spelled = [coded.dictionary.take(pa.array(opening)), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), coded.dictionary.take(pa.array(spaced)), pa.scalar("", pa.large_string()))]
    place[np.append(2 * opening + 1, 2 * spaced)] = words.places(pa.concat_arrays(spelled))
    del split, coded, spelled
    cut = regex.compile(pattern).findall
    whole = np.flatnonzero(close).tolist()
    whole_ids, whole_starts = _replay_texts(ranks, [cut(texts[i].as_py()) for i in whole])
    ids_of = {i: whole_ids[whole_starts[k] : whole_starts[k + 1]] for k, i in enumerate(whole)}
    for i in range(len(texts)):
        yield ids_of[i] if close[i] else gather(words.starts, words.ids, place[unit[offsets[i] : offsets[i + 1]]])


def decode_ids(ranks: Ranks, ids: np.ndarray) -> bytes:
    sizes = ranks.lengths[ids]
    shift = np.repeat(ranks.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
    return ranks.bytes[shift + np.arange(len(shift))].tobytes()


def _content(spark: SparkSession, path: str | None):
    """A vocabulary's file, sent once to each executor; its size is fixed (below 1 MB)."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of a column, of a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers in a binary column.

    A row for each row of docs, repeats and null ids included; null and empty texts have no ids. Extra columns
    are left out. No word leaves its task, which replays each word once as long as it remembers it. With decoded, the bytes that the ids
    decode to are added in the same pass; :func:`decode` does it for ids that are already there.
    """
    content = _content(docs.sparkSession, path)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(content.value)
        words = word_encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text", REPLAY_CHARS):
                ids = list(encode_batch(ranks, part.column("text"), pattern, words))
                out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
                out["ids"] = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                if decoded:
                    out["decoded"] = pa.array([decode_ids(ranks, x) for x in ids], pa.binary())
                del ids
                yield pa.RecordBatch.from_pydict(out)
                del out
            give_back()
        del words
        give_back()

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds decoded, the bytes of ids; null ids decode to null."""
    content = _content(encoded.sparkSession, path)
    names = [f.name for f in encoded.schema]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(content.value)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [None if x is None else decode_ids(ranks, np.frombuffer(x, dtype="<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(of, StructType([*encoded.schema, StructField("decoded", BinaryType())]))
