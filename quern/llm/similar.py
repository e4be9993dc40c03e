"""Near copies by SimHash for the pipeline: fingerprints of five-word shingles meet under covering masks, and exact Jaccard settles the pairs.

Fingerprints of texts at a Jaccard of 0.8 differ in 15 % of their bits, so no mask of a whole fingerprint leaves all of these out.
Fingerprints are therefore as long as the table needs and are cut into parts, each with covering masks of its own. Texts meet where a part agrees
under a mask and are screened by the bits in which their fingerprints differ. What is left are groups, which are joined by the shingles of few pairs;
only members whom these leave apart are compared with each other, all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import materialize, scratch, whole_runs
from quern.llm.components import components, local_labels
from quern.llm.simhash import SEED, covering_masks, shingle_hashes
from quern.operators.joins import lookup_join, salted_join

SHINGLE = 5
JACCARD = 0.8
#: Share of the bits in which fingerprints of a pair at JACCARD differ (the angle between their sets).
FLIPPED = math.acos(2 * JACCARD / (1 + JACCARD)) / math.pi
#: Sets of SHORT shingles at most are short. Sums of so few signs are often 0, so short pairs differ in up to SHORT_FLIPPED of the bits (4 of 5 shingles: half of
#: the 6 sums of 16 that are 0). Short sets have fingerprints of more parts and, among each other, wider screens. Other pairs at JACCARD differ in 0.156 at most.
SHORT, SHORT_FLIPPED = 32, 3 / 16
#: Masks of a part cover so many differing bits.
COVERED = 1
#: A pair at JACCARD meets in no bucket with this probability.
MISSED = 0.0001
#: Parts have so many bits that unrelated texts make buckets of about so many members at most.
MEMBERS = 512
#: Of SCREEN bits fingerprints of pairs at JACCARD differ in 19 on average, with a deviation of 4, unrelated ones in 64, with one of 6;
#: of LONG bits in 78, with one of 8. Pairs that differ in more than RADIUS and LONG_RADIUS are not compared.
SCREEN, RADIUS = 128, 38
LONG, LONG_RADIUS = 512, 124
#: The same for pairs of short sets, which differ in 24 and 96 on average, with a deviation of 4.4 and 8.8.
SHORT_RADIUS, SHORT_LONG_RADIUS = 44, 136
#: Different sets of fewer shingles have a Jaccard below JACCARD.
LEAST = 4
#: Members of a bucket that a task takes at once, and those of a group with their texts.
BLOCK = 1024
TEXTS = 512
#: Of members with more pairs than so many each only a tree of pairs goes on, and they may meet again.
FEW = 2


def shingles(text: str | None) -> np.ndarray:
    """The sorted different hashes of a text's word shingles."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, SHINGLE)]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def layout(n: int, flipped: float = FLIPPED) -> tuple[int, int]:
    """(parts, bits of each) of fingerprints in a table of n texts: longer parts and more of them, as the power 0.24 of n."""
    third = max(3, math.ceil(math.log2(max(n, 1) / MEMBERS) / 2))
    agree = (1 - flipped) ** third
    met = 3 * agree**2 - 2 * agree**3  # two thirds at least of a part agree, which is what a mask for one bit keeps
    return math.ceil(math.log(MISSED) / math.log(1 - met)), 3 * third


def fingerprint(hashes: np.ndarray, bits: int) -> np.ndarray:
    """So many bits (a multiple of 64) of a sorted set of hashes, each of which gives as many: 1 if set in over half of them, and of a tie one hash's.

    Repeats don't count, as for Jaccard, and settled ties leave no bit likelier 0 than 1, however small the set. Ties of each byte are settled by another
    hash, the one whose byte before is least: a hash that settled all would set sets apart that differ in just this one.
    """
    step = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones, settled = np.zeros(bits, np.int64), 0
    for i in range(0, len(hashes), 255):  # what a byte can count
        z = hashes[i : i + 255, None] + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        given = (z ^ (z >> np.uint64(31))).view(np.uint8)
        of = np.unpackbits(given, axis=1, bitorder="little")
        ones += np.add.reduce(of, axis=0, dtype=np.uint8)
        if not i:
            at = np.arange(bits // 8)
            settled = np.unpackbits(given[np.roll(given.argmin(axis=0), 1), at], bitorder="little")
    return 2 * ones + settled > len(hashes)


def table_keys(prints: np.ndarray, parts: int, width: int) -> np.ndarray:
    """For rows of bits a key per part and covering mask: the bits that the mask keeps of the part."""
    kept = np.array([[i for i in range(width) if m >> i & 1] for m in covering_masks(COVERED, width)])
    at = (np.arange(parts)[:, None, None] * width + kept).reshape(-1, kept.shape[1])
    return prints[:, at].astype(np.int32) @ (1 << np.arange(kept.shape[1], dtype=np.int32))


def with_keys(docs: DataFrame) -> DataFrame:
    """(id, text, node, short, code, fp, fq, keys): node is the digest of the set of shingles, short whether it has SHORT at most, code the first LONG bits of its
    fingerprint, fp and fq the first SCREEN.

    Sets of fewer than LEAST shingles have no keys, short ones those of other sets and more.
    """
    n = docs.count()
    (parts, width), (more, _) = layout(n), layout(n, SHORT_FLIPPED)
    bits, most = (max(LONG, -(-k * width // 64) * 64) for k in (parts, more))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets = [shingles(text) for text in rows["text"]]
            short = np.array([len(x) <= SHORT for x in sets], bool)
            prints = [fingerprint(x, most if s else bits) for x, s in zip(sets, short, strict=True)]
            code = np.packbits(np.array([x[:LONG] for x in prints], bool).reshape(-1, LONG), axis=1, bitorder="little").view(np.int64)
            keys = np.empty(len(sets), object)
            for some, k, width_of in ((~short, parts, bits), (short, more, most)):
                of_some = np.array([prints[i] for i in np.flatnonzero(some)], bool).reshape(-1, width_of)
                for i, of_set in zip(np.flatnonzero(some), table_keys(of_some, k, width), strict=True):
                    keys[i] = of_set if len(sets[i]) >= LEAST else of_set[:0]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            told = {"node": node, "short": short, "code": list(code), "fp": code[:, 0], "fq": code[:, 1], "keys": keys}
            yield rows.reset_index(drop=True).assign(**told)

    given = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return given.mapInPandas(of, "id long, text string, node long, short boolean, code array<long>, fp long, fq long, keys array<int>")


def within(apart: np.ndarray, short: np.ndarray, radius: int, wide: int) -> np.ndarray:
    """Whether so many bits are ``radius`` at most, or ``wide`` for two short sets."""
    near, some = apart <= radius, np.flatnonzero(short)
    near[np.ix_(some, some)] = apart[np.ix_(some, some)] <= wide
    return near


def counts(fp: np.ndarray, fq: np.ndarray, short: np.ndarray) -> np.ndarray:
    """For every two members in how many of SCREEN bits they agree; 0 if they can't be alike."""
    apart = np.bitwise_count(fp[:, None] ^ fp) + np.bitwise_count(fq[:, None] ^ fq)
    same = np.where(within(apart, short, RADIUS, SHORT_RADIUS), SCREEN - apart, 0).astype(np.uint8)
    np.fill_diagonal(same, 0)
    return same


def long_counts(code: np.ndarray, short: np.ndarray) -> np.ndarray:
    """The same of LONG bits, for rows of words; 0 if either screen tells them apart."""
    apart = np.zeros((len(code), len(code)), np.uint16)
    for word in code.T[2:]:
        apart += np.bitwise_count(word[:, None] ^ word)
    same = counts(code[:, 0], code[:, 1], short)
    apart += SCREEN - same.astype(np.uint16)
    return np.where((same > 0) & within(apart, short, LONG_RADIUS, SHORT_LONG_RADIUS), LONG - apart, 0).astype(np.uint16)


def forest(same: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) that join the trees (root: a member of each one's) of all who may be alike, each to another by the pair that agrees in most bits."""
    every, a, b = np.arange(len(same)), [], []
    while True:
        open_ = np.where(root[:, None] != root, same, 0)
        other = open_.argmax(axis=1)
        value = open_[every, other].astype(int)
        order = np.lexsort((every, -value, root))
        first = order[np.r_[True, root[order][1:] != root[order][:-1]]]
        first = first[value[first] > 0]
        if not len(first):
            a, b = (np.concatenate([every[:0], *x]) for x in (a, b))
            return np.minimum(a, b), np.maximum(a, b)
        a.append(first)
        b.append(other[first])
        root = local_labels(root[first], root[other[first]], len(same))[root]


def chosen(same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, some, tree): all pairs of trees with few, :func:`forest` of the others, and these others' members and trees."""
    a, b = np.nonzero(np.triu(same))
    tree = local_labels(a, b, len(same))
    many = np.bincount(tree[a], minlength=len(same)) > FEW * np.bincount(tree, minlength=len(same))
    some = np.flatnonzero(many[tree])
    if not len(some):
        return a, b, some, some
    few = ~many[tree[a]]
    x, y = forest(same[np.ix_(some, some)], np.arange(len(some)))
    return np.r_[a[few], some[x]], np.r_[b[few], some[y]], some, tree[some]


def _units(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    for rows in whole_runs(batches, by):
        of = rows[by].to_numpy()
        start = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]).any(axis=1)])
        for i, j in zip(start.tolist(), [*start[1:].tolist(), len(rows)], strict=True):
            yield rows.iloc[i:j]


def _meet(waiting: DataFrame) -> DataFrame:
    """(a, b) of pairs that may be alike, and (t, key, tree, node) of members who may have more such pairs.

    Buckets are dealt into blocks of about BLOCK members, which are worked through by themselves. More pairs may have
    those of whom a forest is given; and, in buckets of several blocks, all (as one tree).
    """
    unit = ["t", "key", "part"]

    def told(**columns: np.ndarray) -> pd.DataFrame:
        none = pd.array([pd.NA] * len(next(iter(columns.values()))), dtype="Int64")
        return pd.DataFrame({c: pd.array(columns[c], dtype="Int64") if c in columns else none for c in ("a", "b", "t", "key", "tree", "node")})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, unit):
            of_unit = rows[unit].to_numpy()
            start = np.flatnonzero(np.r_[True, (of_unit[1:] != of_unit[:-1]).any(axis=1)])
            fp, fq, node, several = rows["fp"].to_numpy().view(np.uint64), rows["fq"].to_numpy().view(np.uint64), rows["node"].to_numpy(), (rows["parts"] > 1).to_numpy()
            short = rows["short"].to_numpy(bool)
            left, right, again, trees = [], [], [], []
            for i, j in zip(start.tolist(), [*start[1:].tolist(), len(rows)], strict=True):
                same = counts(fp[i:j], fq[i:j], short[i:j])
                if same.any():
                    a, b, some, tree = chosen(same)
                    left.append(node[i + a])
                    right.append(node[i + b])
                    if not several[i]:
                        again.append(i + some)
                        trees.append(node[i + tree])
                if several[i]:
                    again.append(np.arange(i, j))
                    trees.append(np.zeros(j - i, np.int64))
            if left:
                yield told(a=np.concatenate(left), b=np.concatenate(right)).drop_duplicates(["a", "b"])
            if again:
                at = np.concatenate(again)
                yield told(tree=np.concatenate(trees), **{c: rows[c].to_numpy()[at] for c in ("t", "key", "node")})

    place = F.struct("t", "key").alias("place")
    large = waiting.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(place, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    dealt = lookup_join(waiting.withColumn("place", place), large, "place", "left").drop("place").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node", "t"), "parts").cast("int"))
    return dealt.repartition(*unit).sortWithinPartitions(*unit, "node").mapInPandas(of, "a long, b long, t int, key int, tree long, node long")


def apart(members: DataFrame, by: list[str], labels: DataFrame, block: int, put: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """(unit, node, label): units in which every two members (node) of a group with different labels (node, label) meet; nodes without a label have their own.

    Labels of many members are cut into blocks of their own, others are put together in blocks of about ``block``, and a unit is one of these or two
    blocks. No unit has only one label, so a large label costs as much as there are members of others, and groups of one label nothing.
    """
    rows = put(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    sizes = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") <= block // 4, F.col("n")).otherwise(0)
    groups = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"), F.ceil(F.sum(small) / block).cast("int").alias("mixed")).where("labels > 1")
    parts = F.when(F.col("n") > block // 4, F.ceil(F.col("n") / block).cast("int")).alias("parts")
    sizes = put(sizes.join(groups, by).select(*by, "label", parts, "mixed"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("i")
    place = lambda own: F.struct(F.lit(own).alias("own"), (F.col("label") if own else F.lit(0).cast("long")).alias("of"), F.col("i").alias("i")).alias("at")
    blocks = sizes.where("parts IS NOT NULL").select(*by, "label", numbers("parts")).select(*by, place(True))
    blocks = blocks.union(sizes.where("mixed > 0").select(*by, "mixed").distinct().select(*by, numbers("mixed")).select(*by, place(False)))
    two = blocks.toDF(*by, "low").join(blocks.toDF(*by, "high"), by)
    one_label = F.col("low.own") & F.col("high.own") & (F.col("low.of") == F.col("high.of"))
    two = two.where((F.col("low") <= F.col("high")) & ~one_label)
    ends = two.select(*by, F.explode(F.array_distinct(F.array("low", "high"))).alias("at"), F.xxhash64(*by, "low", "high").alias("unit"))
    dealt = rows.join(sizes, [*by, "label"])
    dealt = dealt.withColumn("i", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("node"), "parts")).otherwise(F.pmod(F.xxhash64("label"), "mixed")).cast("int"))
    dealt = dealt.withColumn("at", F.when(F.col("parts").isNotNull(), place(True)).otherwise(place(False)))
    return dealt.join(ends, [*by, "at"]).select("unit", "node", "label")


def _trees(label: np.ndarray) -> np.ndarray:
    """For each member the first of its label."""
    _, first, at = np.unique(label, return_index=True, return_inverse=True)
    return first[at]


def screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, same): those of the pairs that differ in LONG_RADIUS of LONG bits at most (short ones in SHORT_LONG_RADIUS), and in how many they agree."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("code").alias(f"code_{end}"), F.col("short").alias(f"short_{end}")), end)
    bits = F.zip_with("code_a", "code_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(bits, F.lit(0), lambda x, y: x + y)
    most = F.when(F.col("short_a") & F.col("short_b"), SHORT_LONG_RADIUS).otherwise(LONG_RADIUS)
    return pairs.where(differ <= most).select("a", "b", (LONG - differ).alias("same"))


def candidates(nodes: DataFrame, put: Callable[[DataFrame], DataFrame] = materialize) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, same) of nodes (node, short, code, fp, fq, keys) that may be alike, and the groups (node, root) that they make.

    The groups are those of all pairs that meet in a bucket of equal keys and that both screens let through. A large group's pairs
    are never all given: a forest in each bucket, and where the longer fingerprints break it, the pairs that mend it.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _units(batches, ["unit"]):
            node, same = rows["node"].to_numpy(), long_counts(np.stack(rows["code"].to_numpy()).view(np.uint64), rows["short"].to_numpy(bool))
            a, b = forest(same, _trees(rows["label"].to_numpy()))
            if len(a):
                yield pd.DataFrame({"a": node[a], "b": node[b], "same": same[a, b].astype(np.int32)})

    first = put(_meet(nodes.select("node", "short", "fp", "fq", F.posexplode("keys").alias("t", "key"))))
    found = put(first.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = put(screened(found, nodes))
    groups = put(components(found, put))
    again = apart(first.where("node IS NOT NULL").select("t", "key", "tree", "node"), ["t", "key", "tree"], groups.toDF("node", "label"), BLOCK, put)
    again = again.join(nodes.select("node", "short", "code"), "node").repartition("unit").sortWithinPartitions("unit", "node")
    more = put(again.mapInPandas(of, "a long, b long, same int").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same").distinct())
    return found.union(more), put(components(groups.toDF("a", "b").union(more.select("a", "b")), put))


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts (node, text; a row for each node) have a Jaccard of JACCARD at least."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            known: dict[str, np.ndarray] = {}
            near = []
            for x, y in zip(rows["x"], rows["y"], strict=True):
                if x not in known:
                    known = {x: shingles(x)}  # rows of one leader follow each other
                near.append(jaccard(known[x], shingles(y)) >= JACCARD)
            yield rows.loc[near, ["a", "b"]]

    both = pairs.join(texts.toDF("b", "y"), "b")
    return salted_join(both, texts.toDF("a", "x"), "a").select("a", "b", "x", "y").mapInPandas(of, "a long, b long")


def joined(sets: list[np.ndarray], may: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) with a Jaccard of JACCARD at least that join the trees of all who have such pairs among those that may."""
    start, size = np.cumsum([0, *map(len, sets)]), np.array([len(x) for x in sets])
    hashes, ids = np.unique(np.concatenate(sets), return_inverse=True)
    root, may, a, b = root.copy(), np.triu(may), [], []
    for i in range(len(sets)):
        other = np.flatnonzero(may[i] & (root != root[i]))
        if len(other):
            there = np.zeros(len(hashes), bool)
            there[ids[start[i] : start[i + 1]]] = True
            both = np.add.reduceat(there[ids], start[:-1], dtype=np.int64)[other]
            near = other[both / (size[i] + size[other] - both) >= JACCARD]
            _, first = np.unique(root[near], return_index=True)
            a += [i] * len(first)
            b += near[first].tolist()
            root[np.isin(root, root[near])] = root[i]
    return np.array(a, int), np.array(b, int)


def links(nodes: DataFrame, texts: DataFrame, put: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """Edges (a, b) that connect all nodes whom pairs of a group of :func:`candidates` that are alike would.

    Each node's likeliest pair and that with its least partner are compared first. Then members of a group whom these leave apart meet in
    units, with their texts, and all their pairs that the screen of LONG bits lets through are compared; edges leave a unit, no pairs.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _units(batches, ["unit"]):
            node, root = rows["node"].to_numpy(), _trees(rows["label"].to_numpy())
            may = (long_counts(np.stack(rows["code"].to_numpy()).view(np.uint64), rows["short"].to_numpy(bool)) > 0) & (root[:, None] != root)
            some = np.flatnonzero(may.any(axis=1))
            if len(some):
                a, b = joined([shingles(x) for x in rows["text"].iloc[some]], may[np.ix_(some, some)], root[some])
                yield pd.DataFrame({"a": node[some[a]], "b": node[some[b]]})

    pairs, groups = candidates(nodes, put)
    texts = put(lookup_join(texts.select("node", "text"), groups.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    ways = pairs.union(pairs.select("b", "a", "same")).groupBy("a").agg(F.max(F.struct("same", "b"))["b"].alias("likeliest"), F.min("b").alias("least"))
    ways = ways.select("a", F.explode(F.array("likeliest", "least")).alias("b"))
    first = put(ways.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = put(components(put(alike(first, texts)), put))
    units = apart(groups.toDF("node", "group"), ["group"], found.toDF("node", "label"), TEXTS, put)
    units = units.join(nodes.select("node", "short", "code"), "node").join(texts, "node").repartition("unit").sortWithinPartitions("unit", "node")
    return found.toDF("a", "b").union(put(units.mapInPandas(of, "a long, b long")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of docs: the smallest doc_id reachable over links between texts that are alike.

    Texts with one set of shingles are linked, those without words among them. Null ids as in simhash.near_duplicates.
    """
    with scratch(docs.sparkSession) as put:
        found = put(with_keys(docs))
        nodes = found.groupBy("node").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("short", "code", "fp", "fq", "keys")])
        nodes = put(nodes)
        root = components(links(nodes, found, put), put).toDF("node", "root")
        rooted = put(nodes.select("node", "least").join(root, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
        named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        groups = found.select("id", "node").join(rooted.join(named, "root").select("node", "component_id"), "node")
        return materialize(groups.select(F.col("id").alias("doc_id"), "component_id"))
