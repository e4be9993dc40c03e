import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from quern.llm import bpe, queries


@pytest.fixture(scope="module")
def content():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(content):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    random.seed(4)
    parts = ["a", "the", " ", "  ", "\n", " \n", "\t", " ", "　", "\x1c", "\x85", "'s", "'LL", "1", "½", "é", "é", "漢字", "😀", "!!", "=", "aaaa", "\r\n", "\x0b", "​", "İ", "\x00"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(n)] + ["a" * 2000, " " * 999, "ab" * 999, "", " ", "\n"]


def test_same_as_the_library(content, library):
    texts = odd_texts(1500)
    ranks = bpe.read_ranks(content)
    found = list(bpe.encode_batch(ranks, pa.array([*texts, None]), P.PATTERN))
    assert [list(x) for x in found] == [library.encode_ordinary(t) for t in [*texts, ""]]
    again = list(bpe.encode_batch(ranks, pa.array([*texts, None]).slice(700), P.PATTERN))
    assert [list(x) for x in again] == [list(x) for x in found[700:]]
    assert [bpe.decode_ids(ranks, x).decode() for x in found[:-1]] == texts


def test_a_batch_is_cut_by_its_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 25, None, "abc", "defg", "hijkl", ""]})
    parts = list(bpe.slices(batch, "text", 10))
    assert sum(map(len, parts)) == 6 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


@pytest.mark.parametrize("most", [1, 60, 100_000])
def test_few_remembered_words(content, library, monkeypatch, most):
    monkeypatch.setattr(bpe, "REMEMBERED", most)
    ranks, texts = bpe.read_ranks(content), odd_texts(300)
    words = bpe.word_encoder(ranks, P.PATTERN)
    found = [list(x) for i in range(0, len(texts), 23) for x in bpe.encode_batch(ranks, pa.array(texts[i : i + 23]), P.PATTERN, words)]
    assert found == [library.encode_ordinary(t) for t in texts]


def test_documents(make, odd_rows, library):
    docs = make(odd_rows, clashing=True)
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, bpe.encode(docs, decoded=True).collect()))
    assert len(rows) == len(odd_rows)
    expected = sorted((str(i), struct.pack(f"<{len(x)}I", *x), (t or "").encode()) for i, t, *_ in odd_rows for x in [library.encode_ordinary(t or "")])
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in rows) == expected
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
