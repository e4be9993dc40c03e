"""Collocations against plain counting."""

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from quern.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_hand(rows, least, longest=5, share=100, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang or "und", tuple(w[i : i + n])] += 1
    phrases = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = set()
    for (lang, w), a in phrases.items():
        for n in range(1, len(w)):
            for i in range(len(w) - n + 1):
                if 100 * a >= share * f[lang, w[i : i + n]]:
                    held.add((lang, w[i : i + n]))
    found = {}
    for (lang, w), a in phrases.items():
        if (lang, w) not in held:
            cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], total[lang]))
    return sorted((lang, i, p.decode(), -a, l, r, n, -s) for lang, x in found.items() for i, (s, a, p, l, r, n) in enumerate(sorted(x)[:top], 1))


def told(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


ODD = [
    ("The Cat sat. the cat sat, the cat sat on the mat", "en"), ("the cat sat on the mat the cat sat on the mat", "en"), ("a\x01 b a\x01 b a b a b", None), ("a\x01 b", "und"), ("x\x1cy x\x1cy z\x0bw\tw  w", "fr"),
    ("É é É é", "fr"), ("", "en"), (None, "en"), (None, None), (" . , ", "de"), ("das das das das das das", "de"), ("w " * 4000, "es"),
]


@pytest.mark.parametrize("ranges", [5_000, 3])
def test_equals_counting(spark, make, monkeypatch, ranges):
    """Also over many ranges, whose borders fall into phrases and among beginnings."""
    monkeypatch.setattr(collocations, "RANGE_ROWS", ranges)
    rows = ODD + [(f"{a} {b} {c} {a} {b}", "en") for a in "abcd" for b in "abc" for c in "ab"] * 2
    docs = make([(i, *r) for i, r in enumerate(rows)], clashing=True)
    for least in (1, 2, 5):
        assert told(collocations.mine(docs, least=least)) == by_hand(rows, least)


TEXTS = st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "ab", "a\x01", "."]), max_size=12).map(" ".join), st.sampled_from(["en", "de", None])), max_size=6)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS, st.integers(1, 3), st.integers(1, 3), st.sampled_from([60, 100]))
def test_any_texts(spark, make, monkeypatch, rows, least, ranges, share):
    monkeypatch.setattr(collocations, "RANGE_ROWS", ranges)
    docs = make([(i, *r) for i, r in enumerate(rows)])
    assert told(collocations.mine(docs, least=least, share=share, top=4)) == by_hand(rows, least, share=share, top=4)


def test_filter_holds_what_was_put_in(spark):
    import pyarrow as pa

    kept = [("en", "a b"), ("de", "é"), ("", "x")]
    bits = collocations.frequent_filter(spark.createDataFrame(kept, "lang string, phrase string"))
    asked = [*kept, ("en", "é"), ("de", "a b"), ("en", "b")]
    found = collocations._passes(bits, pa.array([x for x, _ in asked], pa.large_string()), pa.array([p for _, p in asked], pa.large_string()))
    assert found.tolist() == [True] * 3 + [False] * 3
