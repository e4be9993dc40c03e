"""Alignment of two tokenizers against the libraries, text by text."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings, strategies as st
from tokenizers import Tokenizer

from quern.llm import alignment

ODD = [
    "a", " lead", "two  spaces", "end ", "line\nline", "line \n line\n\n\nx", "tab\tx\r\n y", "it's 12,345.67 don't", "für ñandú 漢字 😀 é", "<|endoftext|> </s> <s> <unk> <0x41>", "x▁y", " no break   em", "\x1c \x85 \x0b", "\x00z", "...",
    "a" * 3000, "   ", "\n", "\n\na b", "word " * 200,
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The usual table of byte-level vocabularies, by counting up."""
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    more = 0
    table = {}
    for b in range(256):
        if b in shown:
            table[chr(b)] = b
        else:
            table[chr(256 + more)] = b
            more += 1
    return table


BYTES = byte_of()


def by_hand(libraries, text):
    """(tokens of a, tokens of b, groups, links) from the libraries alone."""
    a, b = libraries
    none = [], [], [], []
    if not text:
        return none
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(BYTES[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return none
    spans_a, spans_b = [], []
    for spans, tokens in ((spans_a, bytes_a), (spans_b, bytes_b)):
        at = 0
        for t in tokens:
            spans.append((at, at + len(t)))
            at += len(t)
    ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    groups, i, j = [], 0, 0
    for e in ends:
        groups.append(([], []))
        while i < len(spans_a) and spans_a[i][1] <= e:
            groups[-1][0].append(ids_a[i])
            i += 1
        while j < len(spans_b) and spans_b[j][1] <= e:
            groups[-1][1].append(ids_b[j])
            j += 1
    links, k = [], 0
    for i, (s, e) in zip(ids_a, spans_a):
        while k and spans_b[k][0] > s:
            k -= 1
        while spans_b[k][1] <= s:
            k += 1
        for j in range(k, len(spans_b)):
            if spans_b[j][0] >= e:
                break
            links.append((i, ids_b[j]))
    return ids_a, ids_b, groups, links


def expected(libraries, rows):
    found = [by_hand(libraries, t) for t in rows]
    counts = Counter(p for _, _, _, links in found for p in set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for ids_a, ids_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), text, sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links)))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


@pytest.mark.parametrize("room", [alignment.BROADCAST_BYTES, 0])
def test_equals_the_libraries(spark, make, sf, libraries, odd_rows, room):
    """Broadcast and joined counts alike; odd texts, nulls, repeats, clashing names."""
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(ODD)] + [(300 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    found = alignment.cross_align(make(rows, clashing=True), broadcast_bytes=room)
    told = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found.collect()), key=repr)
    assert told == sorted(((r[0], *x) for r, x in zip(rows, expected(libraries, [r[1] for r in rows]), strict=True)), key=repr)


def test_many_batches_and_little_memory(spark, make, libraries, monkeypatch):
    """Tasks that forget, hand on counts early and cut small slices give the same. Workers are forked with the module as it is here, so it runs in this process."""
    for name, value in (("TEXT_BYTES", 40), ("REMEMBERED", 5), ("PAIRS_AT_ONCE", 10), ("TOGETHER", 2)):
        monkeypatch.setattr(alignment, name, value)
    pair = alignment.Pair(open(public_tokenizers.path("byte_bpe_50k.json")).read(), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    units, place, starts = alignment.cut_units(pa.array(ODD, pa.large_string()))
    known = alignment._Remembered(pair, True)
    at = known.places(units)[place]
    for i, (text, x) in enumerate(zip(ODD, expected(libraries, ODD), strict=True)):
        mine = at[starts[i] : starts[i + 1]]
        if known.right[mine].all():
            assert "".join(known.texts[mine].tolist())[:-1] == x[4], text
            assert known.sizes[mine].sum(axis=0).tolist() == list(x[:4])
        else:
            assert x[0] == 0, text


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(st.sampled_from("ab \n\t.'sé漢1 ▁\x1c"), max_size=12))
def test_units_never_cut_a_token(libraries, text):
    if not hasattr(test_units_never_cut_a_token, "pair"):
        test_units_never_cut_a_token.pair = alignment.Pair(open(public_tokenizers.path("byte_bpe_50k.json")).read(), open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    units, place, starts = alignment.cut_units(pa.array([text, text + "x"], pa.large_string()))
    known = alignment._Remembered(test_units_never_cut_a_token.pair, True)
    at = known.places(units)[place]
    for i, t in enumerate([text, text + "x"]):
        mine, x = at[starts[i] : starts[i + 1]], expected(libraries, [t])[0]
        if x[0]:
            assert known.right[mine].all() and "".join(known.texts[mine].tolist())[:-1] == x[4]
        else:
            assert not t or not known.right[mine].all()


def test_perfect_hash():
    """Different numbers from 0 on without a gap, and no number for other keys, for no key, one and many."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 2**47, n))
        segments = alignment.segment_of(keys)
        rows = [(s, *alignment.build_hash(keys[segments == s])) for s in np.unique(segments).tolist()]
        found = alignment.PerfectHash(*(list(x) for x in zip(*rows)) if rows else ([], [], [], []))
        numbers = found.find(keys)
        assert sorted(numbers.tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(0, 2**47, 1000), keys)
        assert (found.find(others) == -1).all()


def test_counts_are_documents(spark, make, libraries):
    docs = make([(1, "the cat the cat"), (2, "the dog"), (2, "the dog"), (3, None)])
    found = {(r["a"], r["b"]): r["n"] for r in alignment.linked_pairs(alignment.count_links(docs)).collect()}
    each = [set(by_hand(libraries, t)[3]) for t in ("the cat the cat", "the dog", "the dog")]
    assert found == Counter(p for x in each for p in x)


def test_empty_table(spark, make):
    for room in (alignment.BROADCAST_BYTES, 0):
        assert alignment.cross_align(make([]), broadcast_bytes=room).count() == 0
        assert [tuple(r) for r in alignment.cross_align(make([(1, None), (2, "")]), broadcast_bytes=room).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]
