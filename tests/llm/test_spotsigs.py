import hashlib
import re

import duckdb
import pytest
import regex

from quern.llm import queries, spotsigs


def sigs(text):
    text = text or ""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    chains = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            rest = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:2]
            if len(rest) == 2:
                chains.add(" ".join(rest))
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()[:8]
    return sorted({digest(c) for c in chains}) if chains else [digest(text)] if text else []


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    last = 2**63
    order = sorted(rows, key=lambda r: -r[0] if r[0] is not None else last)
    out = []
    for i, (d, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = sigs(text), sigs(edited), sigs(after)
        out.append((str(d), len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    return sorted(out)


def found(df):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in df.select(names).collect())


@pytest.mark.parametrize("size", [1, 2, 32])
def test_documents(make, odd_rows, monkeypatch, size):
    monkeypatch.setattr(spotsigs, "ROWS_PER_RANGE", size)
    docs = make(odd_rows, clashing=True)
    assert found(spotsigs.edited_likeness(docs)) == expected([(r[0], r[1]) for r in odd_rows])
    assert spotsigs.edited_likeness(docs.limit(0)).count() == 0


def test_one_document_and_no_ids(make):
    assert found(spotsigs.edited_likeness(make([(3, "the red house stands 🙂é")]))) == expected([(3, "the red house stands 🙂é")])
    both = found(spotsigs.edited_likeness(make([(None, "the red house"), (None, "a green tree grows")])))
    assert [r[1] for r in both] == [13, 18] or [r[1] for r in both] == [18, 13]
    assert len({r[2] for r in both}) == 2


def test_near_classes_find_every_close_pair(make):
    text = [f"the {chr(97 + i % 26)}{i} word{i} of" for i in range(60)]
    rows = [(i, " ".join(text[:i] + [f"new{i} thing the"] + text[i + 1 :])) for i in range(8)]
    rows += [(100, " ".join(text)), (101, " ".join(text)), (200, " ".join(text[:30])), (201, None), (202, "")]
    docs = make(rows)
    pairs = {(r["a"], r["b"]): r["likeness"] for r in spotsigs.near_classes(docs).collect()}
    by_class = {r["class_id"]: set(sigs(dict(rows)[r["class_id"]])) for r in spotsigs.classes(docs).collect()}
    expected_pairs = {(a, b): jaccard(x, y) for a, x in by_class.items() for b, y in by_class.items() if a < b and jaccard(x, y) >= 0.8 and x}
    assert expected_pairs and pairs.keys() == expected_pairs.keys()
    assert {r["doc_id"]: r["class_id"] for r in spotsigs.classes(docs).collect()}[101] == 100


def test_anchors_are_plain_words():
    assert len(set(spotsigs.ANCHORS)) == len(spotsigs.ANCHORS) and all(re.fullmatch(r"\w+", w) for w in spotsigs.ANCHORS)


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = "doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next"
    told = con.sql(f"SELECT {names} FROM ({queries.OP1_SQL})").fetchall()
    assert found(queries.op1_spot_signatures(spark, sf)) == sorted((str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in told)
