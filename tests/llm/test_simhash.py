import random
from itertools import combinations

import numpy as np
import xxhash

from quern.llm import components as cc, queries, simhash


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values, linked):
    """values: (id, value); the smallest id of each one's component."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        if linked(values[i][1], values[j][1]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, (name, _) in enumerate(values):
        groups.setdefault(find(i), []).append(name)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(values))]


def test_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i, j in combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)
    assert all(32 <= m.bit_count() <= 40 for m in masks)


def test_lookup_of_masks_links_like_pairs():
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**60))
    fps = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.integers(0, 12, rng.integers(0, 5))) for _ in range(600)], dtype=np.uint64))
    pairs = cc.local_labels(*simhash._links_in_run(fps, 2), len(fps))
    try:
        simhash.PAIRWISE, kept = 5, simhash.PAIRWISE
        masks = cc.local_labels(*simhash._links_in_run(fps, 2), len(fps))
    finally:
        simhash.PAIRWISE = kept
    assert np.array_equal(pairs, masks)


def test_local_labels_of_random_graphs():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 60))))
        pairs = set(zip(a.tolist(), b.tolist(), strict=True))
        expected = brute_components([(i, i) for i in range(n)], lambda x, y: (x, y) in pairs or (y, x) in pairs)
        assert cc.local_labels(a, b, n).tolist() == expected


def test_components_of_chains_stars_and_loops(spark):
    random.seed(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(7, x) for x in range(300, 340)] + [(5, 5), (900, 901), (901, 900), (None, 4)]
    random.shuffle(edges)
    found = {r["node"]: r["root"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 7: 7, **{x: 7 for x in range(300, 340)}, 900: 900, 901: 900}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(make, odd_rows):
    random.seed(3)
    near = [(100 + i, " ".join(f"word{j}" if j != i else "other" for j in range(400))) for i in range(20)]
    rows = [*odd_rows, *near]
    docs = make(rows, clashing=True)
    found = simhash.near_duplicates(docs).collect()
    values = [(r[0], brute_fingerprint(r[1] or "")) for r in rows]
    expected = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in found) == sorted((str(v[0]), v[1], c) for v, c in zip(values, expected, strict=True))
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r, c in zip(rows, expected, strict=True) if r[0] in (None, c))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, sf):
    docs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = dict(zip((d for d, _ in docs), brute_components(docs, lambda a, b: (a ^ b).bit_count() <= 2), strict=True))
    found = queries.op7_simhash_groups(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {d: (f"{f:016x}", expected[d]) for d, f in docs}
