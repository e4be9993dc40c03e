import hashlib
import random

import pytest

from quern.llm import queries, substring


def brute(rows, window=20):
    """Kept words by (doc_id, position in rows)."""
    last = 2**63 - 1
    texts = [(d if d is not None else last, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in sorted(texts):
        for i in range(len(w) - window + 1):
            key = b" ".join(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[b" ".join(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        out.append((len(w), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def rows():
    random.seed(5)
    base = [random.choice("abcdefg") for _ in range(300)]
    out = []
    for i in range(90):
        w = base[random.randint(0, 50) : random.randint(100, 300)]
        for _ in range(random.randint(0, 3)):
            w[random.randrange(len(w))] = random.choice("xyz")
        out.append((i, " \n".join(w) if i % 2 else " ".join(w)))
    return out + [(500, "a " * 300), (501, "a " * 100), (502, "one two")]


def compare(docs, expected, **options):
    left = substring.remove_repeats(docs, **options).collect()
    found = sorted((str(r["doc_id"]), r["n_words"], (r["text"] or "").encode().split()) for r in left)
    assert found == expected


@pytest.mark.parametrize("hot", [50_000, 3])
def test_same_as_brute_force(make, hot):
    given = rows()
    compare(make(given, parts=6), sorted((str(d), n, k) for (d, _), (n, k) in zip(given, brute(given), strict=True)), hot_runs=hot)


@pytest.mark.parametrize("few", [1, 20])
def test_bounded_state(make, monkeypatch, few):
    """Whatever a task may hold, and whether hot minimisers are broadcast or joined, the rows are the same."""
    monkeypatch.setattr(substring, "REMEMBERED", few)
    monkeypatch.setattr(substring, "LOCAL_RUNS", few)
    monkeypatch.setattr(substring, "MOST_HOT", 0)
    given = rows() + [(7, "a b c " * 30), (7, "x y z " * 30)]
    compare(make(given, parts=5), sorted((str(d), n, k) for (d, _), (n, k) in zip(given, brute(given), strict=True)), hot_runs=3)


def test_odd_rows(make, odd_rows):
    given = [*odd_rows, (6, odd_rows[6][1])]
    docs = make(given, clashing=True)
    pairs = [(r[0], r[1]) for r in given]
    compare(docs, sorted((str(d), n, k) for (d, _), (n, k) in zip(pairs, brute(pairs), strict=True)))
    cut = substring.remove_repeats(docs)
    assert cut.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed"]
    assert [r["text"] for r in cut.where("doc_id = 3").collect()] == [None]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_runs_hold_every_window_once():
    random.seed(6)
    for n in (0, 19, 20, 21, 200):
        words = [random.choice([b"a", b"b"]) for _ in range(n)]
        runs = substring.super_kmers(words)
        assert [i for s, c in zip(runs.start, runs.count, strict=True) for i in range(s, s + c)] == list(range(max(0, n - 19)))


def test_query(spark, sf):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = {d: (n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for (d, _), (n, k) in zip(given, brute(given), strict=True)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op9_repeated_windows(spark, sf).collect()} == expected


def test_rows_without_an_id(make):
    """Many rows without an id, equal and different ones: they come last and none is earlier than another at the same start."""
    given = [(d if d % 3 else None, t) for d, t in rows()] + [(None, "a " * 60)] * 5 + [(2**63 - 1, "b c " * 40)]
    compare(make(given, parts=4), sorted((str(d), n, k) for (d, _), (n, k) in zip(given, brute(given), strict=True)), hot_runs=3)
