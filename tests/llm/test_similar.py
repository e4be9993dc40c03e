import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from quern.llm import similar


def brute(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def like(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def components(rows):
    sets = [(r[0], brute(r[1])) for r in rows]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if root[i] != root[j] and like(sets[i][1], sets[j][1]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    least = {}
    for r, (d, _) in zip(root, sets, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[r] for r in root]


def copies(n, words, changes, start, source):
    """Each has other words in up to so many places."""
    return [(start + i, " ".join(f"z{random.random()}" if k in some else w for k, w in enumerate(words)), "en", source) for i in range(n) for some in [set(random.sample(range(len(words)), random.randint(0, changes)))]]


def test_stage_is_brute_force_jaccard(spark, make, odd_rows, monkeypatch):
    random.seed(5)
    rows = list(odd_rows)
    for g in range(40):
        rows += copies(4, [f"g{g}w{random.randrange(500)}" for _ in range(200)], 10, 1000 + 10 * g, "a")
    docs = make(rows, clashing=True)
    expected = components(rows)
    for block in (4096, 2):  # the second: several rounds of leaders
        monkeypatch.setattr(similar, "BLOCK", block)
        kept = corpus_pipeline.drop_near_copies(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r, c in zip(rows, expected, strict=True) if r[0] in (None, c))


def test_large_group_and_chains(spark, make):
    random.seed(6)
    words = [f"w{i}" for i in range(300)]
    rows = copies(150, words, 6, 0, "a")
    expected = components(rows)
    found = similar.near_duplicates(make(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == sorted((r[0], c) for r, c in zip(rows, expected, strict=True))


def test_nothing(spark, make, odd_rows):
    assert similar.near_duplicates(make(odd_rows).limit(0)).count() == 0


def test_texts_meet_by_parts_of_their_fingerprints():
    random.seed(7)
    prints = np.random.default_rng(7).random((50, 128)) < 0.5
    near = prints.copy()
    for row in near:  # one bit in each part
        row[[12 * p + random.randrange(12) for p in range(10)]] ^= True
    a, b = similar.table_keys(prints, 10, 12), similar.table_keys(near, 10, 12)
    assert ((a == b).reshape(50, 10, -1).sum(axis=2) > 0).all()
    near[:, :12] ^= True
    assert (a[:, :3] != similar.table_keys(near, 10, 12)[:, :3]).all()


def test_a_large_group_gives_a_tree_of_pairs():
    for n in (100, 400):
        same = np.random.default_rng(n).integers(90, 128, (n, n)).astype(np.uint8)
        same = np.maximum(np.triu(same, 1), np.triu(same, 1).T)
        a, b, some, tree = similar.chosen(same)
        assert n - 1 <= len(set(zip(a.tolist(), b.tolist(), strict=True))) < 2 * n and len(some) == n and not tree.any()


def test_members_that_pairs_leave_apart_meet(spark, make, monkeypatch):
    random.seed(9)
    monkeypatch.setattr(similar, "BLOCK", 8)
    monkeypatch.setattr(similar, "TEXTS", 8)
    rows = [r for g in range(3) for r in copies(60, [f"g{g}w{i}" for i in range(300)], 12, 100 * g, "a")]
    found = similar.near_duplicates(make(rows)).collect()
    expected = components(rows)
    assert 3 < len(set(expected)) < len(rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == sorted((r[0], c) for r, c in zip(rows, expected, strict=True))


def test_no_shingle_settles_all_ties():
    some = np.sort(np.random.default_rng(3).integers(2**62, 2**63, 5, np.uint64))
    for other in (1, 2**63 + 1):  # the least and the greatest of six
        more = np.sort(np.r_[some, np.uint64(other)])
        assert (similar.fingerprint(some, 8192) ^ similar.fingerprint(more, 8192)).mean() < 0.19


def test_short_texts_that_differ_by_a_word_are_linked(spark, make):
    random.seed(10)
    rows = []
    for i in range(1000):
        words = [f"s{random.randrange(10**6)}" for _ in range(9 + i % 8)]
        rows += [(2 * i, " ".join(words[:-1])), (2 * i + 1, " ".join(words))]
    found = similar.near_duplicates(make(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(d, d // 2 * 2) for d, _ in rows]
