"""The automaton against edit distance, context and held-out accuracy."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from quern.llm import toxicity
from quern.llm.queries import op12_toxicity
from pyspark.sql import functions as F

LETTERS = st.text(st.sampled_from("abc"), min_size=1, max_size=11)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(LETTERS, st.booleans()), min_size=1, max_size=4, unique=True), LETTERS)
def test_automaton_is_edit_distance(terms, word):
    """The nearest term within its edits, and the pattern before it drops no match."""
    names = [t + toxicity.END * whole for t, whole in terms]
    found = toxicity.Automaton(names)
    near = []
    for k, (t, whole) in enumerate(terms):
        e = distance(t, word) if whole else min(distance(t, word[:i]) for i in range(len(word) + 1))
        if e <= (len(t) >= toxicity.ONE_EDIT) + (len(t) >= toxicity.TWO_EDITS):
            near.append((e, -len(t), k))
    assert found.match(word) == found.nearest(word) == ((min(near)[2], min(near)[0]) if near else None)
    if near:
        assert pa.compute.match_substring_regex(pa.array([word]), found.maybe)[0].as_py()


def features(*texts):
    model = toxicity.Toxicity(["moron$", "idiot"])
    return model.features(toxicity._read(pa.array(texts, pa.large_string())), len(texts), {})


def test_context():
    """Plain, misspelled, quoted, reported, and neither over the border of a text nor from an open mark."""
    x = features("you moron and idiots", "you m0ron", 'they "moron" there', "she called him a moron", "called", "moron", 'a " moron', None, "")
    plain, quoted, odd = x[:, 1], x[:, 2], x[:, 3]
    assert np.allclose(np.expm1(plain), [2, 0, 0, 0, 0, 1, 1, 0, 0])
    assert np.allclose(np.expm1(quoted), [0, 0, 1, 1, 0, 0, 0, 0, 0])
    assert np.allclose(np.expm1(odd), [0, 1, 0, 0, 0, 0, 0, 0, 0])
    assert np.allclose(np.expm1(x[:, 6]), [2, 1, 1, 1, 0, 1, 1, 0, 0])


def test_terms_are_beginnings():
    """A beginning that most toxic documents share stays; one that clean documents have gives way to longer ones."""
    found = {"lowe": (0, 100), "lowei": (0, 100), "loweia": (0, 40), "loweib": (0, 50), "mild": (60, 80), "mildx$": (0, 30), "mildy$": (50, 50)}
    assert toxicity.choose_terms(found) == ["lowei", "mildx$"]


@pytest.fixture(scope="module")
def model(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    return toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").where(~toxicity.held_out()))


def test_held_out(spark, sf, model):
    """English only: the labels of the other languages at this size are too few to learn from."""
    folder = sf.replace("sf0.001", "sf0.01")
    found = op12_toxicity(spark, folder)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert found.count() == docs.count()
    rows = found.join(labels, "doc_id").join(docs.where("lang = 'en'").select("doc_id"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)
    assert not any(r["predicted"] for r in rows if not r["toxic"]) and all(0 <= r["score"] <= 1 for r in rows)
    assert "moron" in {t.removesuffix(toxicity.END) for t in model.terms}


def test_odd_rows(spark, make, odd_rows, model):
    rows = odd_rows + [(50, "moron idiot scum trash loser"), (51, "MORON! idiots, scum; trash; l0ser"), (52, "|".join(["moron"] * 3000))]
    found = {}
    for r in toxicity.score(make(rows, clashing=True), model, ["doc_id", "size"]).collect():
        found.setdefault(r["doc_id"], []).append(r["score"])
    assert sum(map(len, found.values())) == len(rows) and found[2][0] == found[2][1]
    assert found[3] == found[4] and min(found[50][0], found[51][0], found[52][0]) > 0.5 > max(found[1][0], found[3][0], found[6][0])


def test_without_labels(spark, make):
    docs = make([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none), ["doc_id"]).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0), (9, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, one), ["doc_id"]).collect()} == {1.0}
    assert toxicity.score(make([]), toxicity.fit(make([]), none), ["doc_id"]).count() == 0


def test_same_labels_and_repeats(spark, make):
    """Too few documents to be sure of a term: every score is the share of toxic labels."""
    docs = make([(i, "x y z") for i in range(8)])
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(8)], "doc_id long, toxic int")
    scores = [r["score"] for r in toxicity.score(docs.withColumn("score", F.lit(7)), toxicity.fit(docs, labels), ["doc_id", "score"]).collect()]
    assert scores == [0.25] * 8
