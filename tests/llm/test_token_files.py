import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quern.llm import queries, token_files as tf


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_code_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        numbers = rng.integers(0, 2**32, n).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        control, data = tf.pack(numbers)
        assert len(control) == -(-n // 4)
        assert np.array_equal(tf.unpack(control, data, n), numbers)


def test_small_numbers_take_one_byte():
    assert [len(tf.pack(np.array([x]))[1]) for x in (0, 255, 256, 65_535, 65_536, 2**24 - 1, 2**24)] == [1, 1, 2, 2, 3, 3, 4]


def test_same_as_the_library(library):
    random.seed(2)
    parts = ["a", "B", "the", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "'s", "'LL", "1", "½", "é", "é", "́", "漢字", "😀", "!!", "|", "| ", " |", ".", ",", ".,", "a.", "é,", "1.", "a|", "!|", "b(", "`", "~'s", "a^'", "\x0b", "​", "İ", "İ.", "É,", "ΑΣ", "Σ.", "<|endoftext|>", "</w>", "\x00", "ﬁ", "한"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(3000)] + ["", None, " ", "|", "."]
    found = list(tf.encode_texts(library, pa.array(texts)))
    assert [list(x) for x in found] == [library.encode(t or "", add_special_tokens=False).ids + [tf.END] for t in texts]
    again = list(tf.encode_texts(library, pa.array(texts).slice(1700)))
    assert [list(x) for x in again] == [list(x) for x in found[1700:]]
    assert [list(x) for x in tf.encode_texts(library, pa.array([None, ""], pa.string()))] == [[tf.END], [tf.END]]


def rows_of(library, given):
    start, out = 0, []
    for d, text in given:
        ids = library.encode(text or "", add_special_tokens=False).ids + [tf.END]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def read_back(spark, path):
    return [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in tf.read_files(spark, path).orderBy("start").collect()]


@pytest.mark.parametrize("block", [1, 50, 500_000])
def test_documents(spark, make, odd_rows, library, monkeypatch, block):
    monkeypatch.setattr(tf, "BLOCK_TOKENS", block)
    monkeypatch.setattr(tf, "ROWS_PER_FILE", 3)
    docs = make(odd_rows, clashing=True)
    order = sorted(((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert read_back(spark, tf.store(docs)) == rows_of(library, order)


def test_files_ascend(spark, make, monkeypatch, tmp_path):
    monkeypatch.setattr(tf, "ROWS_PER_FILE", 40)
    path = tf.store(make([((7 * i) % 500, f"word{i} the house") for i in range(500)], parts=6), f"file://{tmp_path}/t")
    files = sorted(x for x in tmp_path.joinpath("t").iterdir() if x.name.startswith("part-"))
    assert 5 < len(files) < 30
    starts = [x for f in files for x in spark.read.parquet(f"file://{f}").select("start").toPandas()["start"]]
    assert starts == sorted(starts)
    assert [r["doc_id"] for r in tf.read_files(spark, path).orderBy("start").collect()] == list(range(500))


def test_few_remembered_stems(library, monkeypatch):
    random.seed(4)
    texts = pa.array([" ".join(f"w{random.randint(0, 300)}{random.choice(['', '.', ',!'])}" for _ in range(40)) for _ in range(60)])
    expected = [library.encode(t, add_special_tokens=False).ids + [tf.END] for t in texts.to_pylist()]
    for most in (1, 200, 10_000):
        monkeypatch.setattr(tf, "REMEMBERED", most)
        stems = tf.stem_encoder(library)
        found = [list(x) for i in range(0, 60, 7) for x in tf.encode_texts(library, texts.slice(i, 7), stems)]
        assert found == expected


def test_empty_table(spark, make, odd_rows):
    assert tf.read_files(spark, tf.store(make(odd_rows).limit(0))).count() == 0


def test_frequent_ids_get_small_codes(spark, make):
    counts = tf.id_counts(tf.tokenize(make([(1, "the the the house"), (2, "the")])))
    assert counts.sum() == 7 and counts.max() == 4


def test_query(spark, sf, library):
    given = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op4_token_files(spark, sf).collect())
    assert found == rows_of(library, given)


def test_added_tokens_in_a_text(spark, make):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    random.seed(3)
    parts = ["a", " ", "the", ".", "x<|endoftext|>", "<|endoftext|>", " <|startoftext|> ", "<|ENDOFTEXT|>", "<|endoftext", "|>", "É"]
    texts = ["one <|endoftext|> two", None, ""] + ["".join(random.choice(parts) for _ in range(random.randint(0, 9))) for _ in range(500)]
    assert list(next(tf.encode_texts(library, pa.array(texts)))) == [637, 49407, 1237, tf.END]
    assert [list(x) for x in tf.encode_texts(library, pa.array(texts))] == [library.encode(t or "", add_special_tokens=False).ids + [tf.END] for t in texts]
    assert [list(x) for x in tf.encode_texts(library, pa.array(texts).slice(100))] == [library.encode(t or "", add_special_tokens=False).ids + [tf.END] for t in texts[100:]]
    given = list(enumerate(texts[:40]))
    assert read_back(spark, tf.store(make(given))) == rows_of(library, given)


def test_a_vocabulary_of_more_than_16_bits_is_an_error(make, tmp_path):
    from tokenizers import Tokenizer, models

    path = tmp_path / "wide.json"
    Tokenizer(models.WordLevel({f"w{i}": i for i in range(tf.IDS + 1)}, unk_token="w0")).save(str(path))
    with pytest.raises(ValueError):
        tf.tokenize(make([(1, "w1")]), str(path))
