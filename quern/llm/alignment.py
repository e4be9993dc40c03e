"""Two tokenizers side by side: which tokens overlap, and in how many documents, counted by minimal perfect hashing."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from quern.llm.bpe import gather, own_texts, slices
from quern.llm.common import give_back, materialize

#: Bytes of text that are cut into units together; units and their bytes that a task remembers.
TEXT_BYTES = 4_000_000
REMEMBERED = 400_000
REMEMBERED_BYTES = 64_000_000
#: Units that go to the tokenizers in one string.
TOGETHER = 200
#: Pairs of ids that a task counts before it hands them on.
PAIRS_AT_ONCE = 2_000_000
#: Parts of the pairs, each with a hash of its own (a power of two); sums of a part meet in FAN_IN places first.
SEGMENTS = 1024
FAN_IN = 8
#: Bits of a level of a hash for each key that is left.
ROOM = 1.5
#: Counts of up to so many bytes are broadcast; larger ones are joined.
BROADCAST_BYTES = 64_000_000

_SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: White space that begins a text or stands beside a space or an end of line: such texts are cut one by one.
_CLOSE = rf"^[{_SPACE}]|[ \n][{_SPACE}]|[{_SPACE}][ \n]"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_SPACE_MARK = "▁"


def _bytes_of_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Vocabulary:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.append(0, np.cumsum(self.lengths))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        return gather(self.starts, self.flat, ids).tobytes()


class Pair:
    """The two tokenizers and their vocabularies."""

    def __init__(self, bpe: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already run side by side
        self.a, self.b = Tokenizer.from_str(bpe), sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.a.encode_special_tokens = True
        letters, by_id = _bytes_of_letters(), {i: t for t, i in self.a.get_vocab().items()}
        added = self.a.get_added_tokens_decoder()
        self.of_a = _Vocabulary([b"" if i in added or i not in by_id else bytes(letters[c] for c in by_id[i]) for i in range(max(by_id) + 1)])
        self.of_b = _Vocabulary([self._piece(i) for i in range(self.b.get_piece_size())])
        self.text_a = [np.array([f"{i}{end}" for i in range(self.of_a.size)], object) for end in ",|"]
        self.text_b = [np.array([f"{i}{end}" for i in range(self.of_b.size)], object) for end in ",;"]

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE_MARK, " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that begins with a space, or with an end of line where another unit goes before."""
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        if text == " ":  # at the end of a text; the library adds no space to nothing
            return a, np.array([self.b.piece_to_id(_SPACE_MARK)], np.int64)
        if text[0] == " ":
            return a, np.array(self.b.encode(text[1:]), np.int64)
        return a, np.array(self.b.encode(text)[1:], np.int64)  # without the space that it adds

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the one, ids of the other, which units both spell as they are); the others have no ids.

        No token of either goes across the beginning of a unit, so units that end in no white space are encoded as one text.
        """
        found_a, found_b, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.ones(len(units), bool)

        def one(i: int) -> None:
            a, b = self.encode(units[i])
            right[i] = self.of_a.spell(a) == units[i].encode() == self.of_b.spell(b)
            if right[i]:
                found_a.append(a)
                found_b.append(b)

        def together(i: int, j: int) -> None:
            a, b = self.encode("".join(units[i:j]))
            data = [u.encode() for u in units[i:j]]
            ends = np.cumsum([len(x) for x in data])
            whole = self.of_a.spell(a) == b"".join(data) == self.of_b.spell(b)
            if whole and all(len(np.intersect1d(ends, np.cumsum(v.lengths[x]), assume_unique=True)) == len(ends) for v, x in ((self.of_a, a), (self.of_b, b))):
                found_a.append(a)
                found_b.append(b)
            else:
                for k in range(i, j):
                    one(k)

        start = 0
        for i, u in enumerate([*units, ""]):
            alone = not u or _SPACE_MARK in u or u[-1].isspace()
            if start < i and (alone or i - start == TOGETHER):
                together(start, i)
                start = i
            if alone:
                if u:
                    one(i)
                start = i + 1
        return np.concatenate(found_a), np.concatenate(found_b), right


@dataclass
class Aligned:
    """Of each unit: whether it is spelled right, tokens of both, groups, links, and its groups as text; and all links, (a << 32) + b."""

    right: np.ndarray
    sizes: np.ndarray
    links: np.ndarray
    texts: list[str]


def align(pair: Pair, units: list[str], spelled: bool) -> Aligned:
    """Groups end where tokens of both do. Between two neighbouring ends of either lies just one link, and each link there once."""
    a, b, right = pair.encode_units(units)
    ends = np.cumsum(np.array([len(u.encode()) for u, r in zip(units, right, strict=True) if r], np.int64))
    ends_a, ends_b = np.cumsum(pair.of_a.lengths[a]), np.cumsum(pair.of_b.lengths[b])
    every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    twice = np.zeros(len(every), bool)
    twice[:-1] = every[1:] == every[:-1]
    both, either = every[twice], every[~twice]
    links = (a[np.searchsorted(ends_a, either)] << 32) + b[np.searchsorted(ends_b, either)] if len(either) else np.empty(0, np.int64)
    sizes = np.zeros((len(units), 4), np.int64)
    for k, x in enumerate((ends_a, ends_b, both, either)):
        sizes[right, k] = np.diff(np.searchsorted(x, ends, side="right"), prepend=0)
    texts = [""] * len(units)
    if spelled and len(both):
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        words = np.concatenate([np.where(both[group_a] == ends_a, pair.text_a[1][a], pair.text_a[0][a]), np.where(both[group_b] == ends_b, pair.text_b[1][b], pair.text_b[0][b])])
        words = words[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        stop = np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist()
        texts = ["".join(words[i:j]) for i, j in zip([0, *stop], stop, strict=False)]
    return Aligned(right, sizes, links, texts)


def cut_units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different units, the number of the unit at each place, where each text's begin); empty texts have none.

    A unit begins with a space or an end of line between two other characters, the first with the space before the text.
    """
    close = pc.match_substring_regex(texts, _CLOSE).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    offsets, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
    place = coded.indices.to_numpy().astype(np.int64)
    units = [w if w[:1] == "\n" else f" {w}" for w in coded.dictionary.to_pylist()]
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if not (close | empty).any():
        return units, place, offsets.astype(np.int64)
    number = {u: i for i, u in enumerate(units)}
    parts = [place[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
    for i in np.flatnonzero(close | empty).tolist():
        parts[i] = np.array([] if empty[i] else [number.setdefault(u, len(number)) for u in _CUT.split(f" {texts[i].as_py()}")], np.int64)
    used = np.unique(np.concatenate(parts))
    place = np.searchsorted(used, np.concatenate(parts))
    units = list(number)
    return [units[i] for i in used.tolist()], place, np.append(0, np.cumsum([len(x) for x in parts]))


class _Remembered:
    """Units that a task has met, so that each is aligned once. ``of_links`` makes two columns of numbers of its links."""

    def __init__(self, pair: Pair, spelled: bool, of_links: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None):
        self.pair, self.spelled, self.of_links = pair, spelled, of_links
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.bytes = 0
        self.right, self.sizes, self.sums = np.empty(0, bool), np.empty((0, 4), np.int64), np.empty((0, 2), np.int64)
        self.links, self.starts = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.texts = np.empty(0, object)

    def full(self) -> bool:
        return len(self.place) > REMEMBERED or self.bytes > REMEMBERED_BYTES

    def places(self, units: list[str]) -> np.ndarray:
        new = [u for u in units if u not in self.place]
        if new:
            found = align(self.pair, new, self.spelled)
            for u in new:
                self.place[u] = len(self.place)
            starts = np.append(0, np.cumsum(found.sizes[:, 3]))
            if self.of_links is not None:
                totals = [np.append(0, np.cumsum(x)) for x in self.of_links(found.links)]
                self.sums = np.vstack([self.sums, np.stack([t[starts[1:]] - t[starts[:-1]] for t in totals], axis=1)])
            self.right, self.sizes = np.append(self.right, found.right), np.vstack([self.sizes, found.sizes])
            self.starts = np.append(self.starts, self.starts[-1] + starts[1:])
            self.links = np.append(self.links, found.links)
            texts = np.empty(len(new), object)
            texts[:] = found.texts
            self.texts = np.append(self.texts, texts)
            self.bytes += sum(map(len, new)) + sum(map(len, found.texts)) + 8 * len(found.links)
        return np.array([self.place[u] for u in units], np.int64)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each key."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_of(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0) >> np.uint64(65 - SEGMENTS.bit_length())).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(sizes of levels, bits, keys in the order of their hash) of different keys of one segment.

    Keys that meet no other at their place of a level have its bit; the rest go on to the next. A key's number is how many bits stand before its own.
    """
    sizes, bits, ordered = [], [], []
    while len(keys):
        size = max(8, int(len(keys) * ROOM) // 8 * 8)
        at = (_mix(keys, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        level = np.zeros(size, bool)
        level[at[alone]] = True
        ordered.append(keys[alone][np.argsort(at[alone])])
        sizes.append(size)
        bits.append(level)
        keys = keys[~alone]
    join = lambda x, kind: np.concatenate([*x, np.empty(0, kind)]).astype(kind)
    return np.array(sizes, "<i4").tobytes(), np.packbits(join(bits, bool)).tobytes(), join(ordered, "<i8").tobytes()


class PerfectHash:
    """Minimal perfect hashes of some segments as one: rows (segment, levels, bits, keys) of :func:`build_hash`."""

    def __init__(self, segments: list[int], levels: list[bytes], bits: list[bytes], keys: list[bytes]):
        each = [np.frombuffer(x, "<i4").astype(np.int64) for x in levels]
        deepest = max([0, *map(len, each)])
        self.size, self.offset = np.zeros((SEGMENTS, deepest), np.int64), np.zeros((SEGMENTS, deepest), np.int64)
        done = 0
        for s, x in zip(segments, each, strict=True):
            self.size[s, : len(x)] = x
            self.offset[s, : len(x)] = done + np.cumsum(x) - x
            done += int(x.sum())
        self.bits = np.concatenate([np.empty(0, bool), *[np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in bits]])
        self.before = (np.cumsum(self.bits) - self.bits).astype(np.int32)
        self.keys = np.concatenate([np.empty(0, "<i8"), *[np.frombuffer(x, "<i8") for x in keys]])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for one that isn't there, as the key stored at the number tells."""
        out = np.full(len(keys), -1, np.int64)
        left, segment = np.arange(len(keys)), segment_of(keys)
        for level in range(self.size.shape[1]):
            size = self.size[segment[left], level]
            left, size = left[size > 0], size[size > 0]
            at = self.offset[segment[left], level] + (_mix(keys[left], level + 1) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        there = out >= 0
        out[there] = np.where(self.keys[out[there]] == keys[there], out[there], -1)
        return out


def _sources(docs: DataFrame, bpe: str | None, pieces: str | None):
    """Both vocabularies, sent once to each executor; their size is fixed (2 MB)."""
    with open(bpe or public_tokenizers.path("byte_bpe_50k.json")) as f:
        content = f.read()
    with open(pieces or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((content, f.read()))


def _first_of_each(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The different values; ``seen`` is room for one number a value."""
    seen[values] = np.arange(len(values))
    return values[seen[values] == np.arange(len(values))]


def _partial_counts(docs: DataFrame, sent) -> DataFrame:
    """(segment, keys, counts): in how many of a task's documents each pair of ids is linked, packed by segment."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(Pair(*sent.value), False)
        number: dict[int, int] = {}
        counts, local = np.zeros(0, np.int64), np.empty(0, np.int64)
        seen, unit_seen = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            keys = np.fromiter(number, np.int64, len(number))
            keys, n = keys[counts > 0], counts[counts > 0]
            segment = segment_of(keys)
            order = np.argsort(segment, kind="stable")
            some, cuts = np.unique(segment[order], return_index=True)
            pack = lambda x: [v.astype("<i8").tobytes() for v in np.split(x[order], cuts[1:])] if len(some) else []
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(pack(keys), pa.binary()), pa.array(pack(n), pa.binary())], names=["segment", "keys", "counts"])

        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                if len(number) > PAIRS_AT_ONCE:
                    yield told()
                    number, counts = {}, np.zeros(0, np.int64)
                    known.forget()
                elif known.full():
                    known.forget()
                before = len(known.links) if known.place else 0
                if not before:
                    local = np.empty(0, np.int64)
                units, place, starts = cut_units(own_texts(part.column("text")))
                at = known.places(units)[place]
                new, back = np.unique(known.links[before:], return_inverse=True)
                ids = np.array([number.setdefault(x, len(number)) for x in new.tolist()], np.int64)
                local = np.append(local, ids[back])
                grow = lambda x, n: np.append(x, np.zeros(max(0, n - len(x)), np.int64))
                counts, seen, unit_seen = grow(counts, len(number)), grow(seen, len(number)), grow(unit_seen, len(known.right))
                for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    mine = _first_of_each(at[i:j], unit_seen)
                    if known.right[mine].all():
                        counts[_first_of_each(gather(known.starts, local, mine), seen)] += 1
            give_back()
        yield told()

    return docs.select("text").mapInArrow(of, "segment int, keys binary, counts binary")


def _by_runs(rows: DataFrame, by: list[str], order: list[str], step: Callable, done: Callable, schema: str) -> DataFrame:
    """Folds the rows of each key in order, one row after the other: ``step(state, row)`` (state None at first), then ``done(key, state)``."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                mine = tuple(getattr(row, c) for c in by)
                if key is not None and mine != key:
                    out.append(done(key, state))
                    state = None
                key = mine
                state = step(state, row)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if key is not None:
            yield pd.DataFrame([done(key, state)], columns=columns)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(of, schema)


def count_links(docs: DataFrame, bpe: str | None = None, pieces: str | None = None) -> DataFrame:
    """(segment, levels, bits, keys, counts): a minimal perfect hash for each segment of the pairs of ids, and in how many documents each is linked.

    Tasks hand on what they have counted. The different keys of a segment make its hash; then counts are added into vectors
    indexed by it, first in FAN_IN places a segment, then these. A segment has at most its share of all pairs of ids of both vocabularies.
    """
    partial = materialize(_partial_counts(docs, _sources(docs, bpe, pieces)))
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("keys", "counts"), F.lit(FAN_IN)).cast("int"))
    union = lambda state, row: np.frombuffer(row.keys, "<i8") if state is None else np.union1d(state, np.frombuffer(row.keys, "<i8"))
    some = _by_runs(salted.select("segment", "salt", "keys"), ["segment", "salt"], [], union, lambda key, keys: (key[0], keys.astype("<i8").tobytes()), "segment int, keys binary")
    hashes = _by_runs(some, ["segment"], [], union, lambda key, keys: (key[0], *build_hash(np.unique(keys))), "segment int, levels binary, bits binary, keys binary")
    hashes = materialize(hashes)

    def add(state: tuple | None, row) -> tuple:
        if row.levels is not None:
            found = PerfectHash([row.segment], [row.levels], [row.bits], [row.keys])
            return found, np.zeros(len(found.keys), np.int64)
        state[1][state[0].find(np.frombuffer(row.keys, "<i8"))] += np.frombuffer(row.counts, "<i8")
        return state

    none = [F.lit(None).cast("binary").alias(c) for c in ("levels", "bits")]
    everywhere = hashes.select("segment", F.explode(F.sequence(F.lit(0), F.lit(FAN_IN - 1))).alias("salt"), "levels", "bits", "keys", F.lit(None).cast("binary").alias("counts"), F.lit(0).alias("turn"))
    both = everywhere.unionByName(salted.select("segment", "salt", *none, "keys", "counts", F.lit(1).alias("turn")))
    vectors = _by_runs(both, ["segment", "salt"], ["turn"], add, lambda key, state: (key[0], state[1].tobytes()), "segment int, counts binary")
    plus = lambda state, row: np.frombuffer(row.counts, "<i8") if state is None else state + np.frombuffer(row.counts, "<i8")
    summed = _by_runs(vectors, ["segment"], [], plus, lambda key, state: (key[0], state.tobytes()), "segment int, counts binary")
    return materialize(hashes.join(summed, "segment"))


def linked_pairs(counted: DataFrame) -> DataFrame:
    """(a, b, n) as rows of what :func:`count_links` gives."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            key, n = (np.concatenate([np.frombuffer(x, "<i8") for x in rows[c]]) for c in ("keys", "counts"))
            yield pd.DataFrame({"a": key >> 32, "b": key & 0xFFFFFFFF, "n": n})

    return counted.select("keys", "counts").mapInPandas(of, "a long, b long, n long")


def _documents(docs: DataFrame, sent, told: Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]] | None, links: bool) -> DataFrame:
    """Aligns every document again, with the sums that ``told`` makes of links, or with the links as they are."""
    extra = ", links array<long>" if links else ", n_best long, count_sum long"
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", *(["links"] if links else ["n_best", "count_sum"])]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(Pair(*sent.value), True, told() if told else None)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                if known.full():
                    known.forget()
                units, place, starts = cut_units(own_texts(part.column("text")))
                at = known.places(units)[place]
                sizes, sums, groups, linked = np.zeros((len(part), 4), np.int64), np.zeros((len(part), 2), np.int64), [], []
                for k, (i, j) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    mine = at[i:j]
                    if not known.right[mine].all():
                        mine = mine[:0]
                    sizes[k] = known.sizes[mine].sum(axis=0)
                    groups.append("".join(known.texts[mine].tolist())[:-1])
                    if links:
                        linked.append(gather(known.starts, known.links, mine))
                    else:
                        sums[k] = known.sums[mine].sum(axis=0)
                more = [pa.array(linked, pa.list_(pa.int64()))] if links else [pa.array(x) for x in sums.T.copy()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x) for x in sizes.T.copy()], pa.array(groups, pa.string()), *more], names=names)
                del groups, linked, more
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string" + extra)


def cross_align(docs: DataFrame, bpe: str | None = None, pieces: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) for every row of docs (doc_id, text).

    ``bpe`` encodes space and text, ``pieces`` the text, to which it adds the space. Where tokens of both end, a group ends; groups
    are written ``a1,a2|b1;a3|b2,b3``. Each pair of tokens whose bytes overlap is a link. n_best counts links whose pair of ids is linked in as
    many documents as any pair of its first id; count_sum adds these numbers of documents over the links.

    Null and empty texts, and texts that one of them does not spell as they are, have no tokens: zeros and an empty text. Each row is a document, rows
    that repeat and null ids, too; other columns are not read. The counts are broadcast if they take no more than ``broadcast_bytes``;
    else they are joined to the links of different groups.
    """
    sent = _sources(docs, bpe, pieces)
    counted = count_links(docs, bpe, pieces)
    best = F.max("n").alias("best")
    pairs = linked_pairs(counted)
    size = counted.agg(F.sum(F.length("keys") + F.length("counts") + F.length("bits") + F.length("levels")).alias("n")).first()["n"] or 0
    if size <= broadcast_bytes:
        most = pairs.groupBy("a").agg(best).toPandas()  # an entry for each id of the vocabulary at most
        rows = counted.toPandas()
        table = docs.sparkSession.sparkContext.broadcast(([list(rows[c]) for c in ("segment", "levels", "bits", "keys", "counts")], most["a"].to_numpy(np.int64), most["best"].to_numpy(np.int64)))

        def told() -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
            (segments, levels, bits, keys, counts), a, top = table.value
            found, n = PerfectHash(segments, levels, bits, keys), np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, "<i8") for x in counts]])
            best_of = np.zeros(int(a.max()) + 1 if len(a) else 1, np.int64)
            best_of[a] = top

            def of_links(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = found.find(links)
                count = np.where(at >= 0, np.append(n, 0)[at], 0)  # links of a unit that is only in documents without tokens aren't counted
                return (count == best_of[np.minimum(links >> 32, len(best_of) - 1)]) & (count > 0), count

            return of_links

        return _documents(docs, sent, told, False)
    # beyond: the links of each different text of groups meet the counts in a join
    aligned = materialize(_documents(docs, sent, None, True))
    listed = aligned.where("n_links > 0").withColumn("of", F.sha2("groups", 256)).dropDuplicates(["of"])
    listed = listed.select("of", F.explode("links").alias("link")).groupBy("of", "link").agg(F.count(F.lit(1)).alias("times"))
    known = pairs.join(pairs.groupBy("a").agg(best), "a").select((F.shiftleft("a", 32) + F.col("b")).alias("link"), "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    sums = listed.join(known, "link").groupBy("of").agg(F.sum(F.col("times") * F.col("is_best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    whole = aligned.withColumn("of", F.sha2("groups", 256)).drop("links").join(sums, "of", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")])
