import base64
import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from test_mixing import targets
from test_similar import components
from test_substring import brute

import corpus_pipeline
from quern.llm import language

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, make, odd_rows, tmp_path_factory):
    """What went into each stage and what came out, and the folder."""
    random.seed(8)
    languages = {"en": "the house of a man with some trees and the river in spring", "fr": "le chat est dans la maison avec les enfants du village", "de": "der hund und die katze sind nicht im haus mit dem kind"}
    rows = [(1000 + i, " ".join(random.choice(languages[lang].split()) + random.choice(["", "s", "x"]) for _ in range(60)), lang, f"s{i % 3}") for i in range(60) for lang in languages]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)] + [(5000 + i, *r[1:]) for i, r in enumerate(odd_rows)] + [(9000, rows[0][1], "en", "s0")]
    passage = " ".join(random.choice("abcdefgh") + "oe" for _ in range(55))
    for i in range(12):
        words = rows[3 * i][1].split()
        rows.append((9100 + i, " ".join([*words[:50], "new", str(i)] if i % 2 else [*words[:20], passage, *words[20:30]]), "en", "s1"))
    top = tmp_path_factory.mktemp("pipeline")
    make(rows).write.parquet(f"file://{top}/documents.parquet")
    docs = spark.read.parquet(f"file://{top}/documents.parquet")
    seen, settings = [], spark.conf.getAll
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, f"file://{top}").write.parquet(f"file://{top}/{i}")
        after = spark.read.parquet(f"file://{top}/{i}")
        seen.append((docs.collect(), after.collect(), after.columns))
        docs = after
    assert spark.conf.getAll == settings
    return seen, f"file://{top}"


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_columns(stages):
    assert [names for *_, names in stages[0]][:-1] == [NAMES] * 4


def test_language_is_predicted_again_without_spark(spark, stages):
    given, kept, _ = stages[0][0]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    model = language.train(docs.where(~language.held_out()))
    names, scores = model.predict([r["text"] for r in given])
    expected = [r["doc_id"] for r, n, s in zip(given, names, scores, strict=True) if n != "und" and s >= 0.2]
    assert Counter(r["doc_id"] for r in kept) == Counter(expected)
    assert {r["doc_id"] for r in kept}.isdisjoint({5003, 5004, 5005, 5009}) and len(kept) == len(given) - 4


def test_near_copies_are_brute_force_jaccard(stages):
    given, kept, _ = stages[0][1]
    roots = components(pairs(given))
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r, c in zip(given, roots, strict=True) if r["doc_id"] == c)
    assert len(kept) < len(given)


def test_repeats_are_brute_force_windows(stages):
    given, cut, _ = stages[0][2]
    expected = {d: (w, n) for (d, _), (n, w) in zip(pairs(given), brute(pairs(given)), strict=True)}
    found = {r["doc_id"]: r for r in cut}
    assert found.keys() == expected.keys() and any(len(w) < n for w, n in expected.values())
    for d, (words, _) in expected.items():
        assert found[d]["text"].encode().split() == words and found[d]["n_chars"] == len(found[d]["text"])


def test_copies_follow_the_rates(stages):
    given, mixed, _ = stages[0][3]
    size = Counter()
    for r in given:
        size[r["source"]] += len(r["text"].encode().split())
    wanted, taken = targets(size), Counter(r["doc_id"] for r in mixed)
    for r in given:
        rate = wanted[r["source"]] / size[r["source"]]
        number = int(hashlib.md5(f"{r['doc_id']}:42".encode()).hexdigest()[:8], 16) / 2**32
        assert taken[r["doc_id"]] == int(rate) + (number < rate - int(rate))


def test_ids_are_the_library_s(stages):
    given, coded, _ = stages[0][4]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((d, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(t))), hashlib.sha256(t.encode()).hexdigest()) for d, t in pairs(given))
    assert Counter((r["doc_id"], zlib.crc32(bytes(r["ids"])), r["decoded_sha256"]) for r in coded) == expected


def test_run(spark, stages):
    found = corpus_pipeline.run(spark, stages[1])
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in found.collect()) == Counter((r["doc_id"], r["ids_sha256"]) for r in stages[0][4][1])


def test_nothing_in_nothing_out(spark, make, odd_rows):
    empty = make(odd_rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language identification", "SimHash near-deduplication", "substring deduplication", "source mixing", "byte-level BPE"]
    assert corpus_pipeline.ORACLE_SQL is None and language.UNKNOWN == "und"
