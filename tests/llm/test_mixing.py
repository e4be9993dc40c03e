import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from quern.llm import mixing, queries


def targets(sizes, weights=(5, 2, 1), share=1.5, ceiling=2.0):
    """Fill by weight, cut what is above, share the excess again, until none is."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        level = left / sum(weight[n] for n in names if n not in full)
        over = [n for n in names if n not in full and level * weight[n] > ceiling * sizes[n]]
        if not over:
            return {n: full.get(n, level * weight[n]) for n in names}
        for n in over:
            full[n] = ceiling * sizes[n]
            left -= full[n]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from("aBcdÄ€🙂")), st.integers(0, 50), min_size=1))
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(rows).collect()}
    expected = targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert {k: v[0] for k, v in found.items()} == sizes
    for name, target in expected.items():
        assert found[name][1] == pytest.approx(target)


def test_taken_words_come_near_their_targets(make):
    random.seed(1)
    rows = [(i, "w " * random.randint(1, 30), None, "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    taken = mixing.with_copies(make(rows)).collect()
    again = mixing.with_copies(make(rows, parts=7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in taken) == sorted((r["doc_id"], r["copies"]) for r in again)
    for source in {r["source"] for r in taken}:
        own = [r for r in taken if r["source"] == source]
        assert sum(r["copies"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=0.15)
    assert max(r["copies"] for r in taken) <= 2


def test_odd_rows_and_salted_join(make, odd_rows, monkeypatch):
    docs = make(odd_rows, clashing=True)
    plain = sorted((str(r["doc_id"]), r["size"], r["target"], r["copies"]) for r in mixing.with_copies(docs).collect())
    assert len(plain) == len(odd_rows)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted((str(r["doc_id"]), r["size"], r["target"], r["copies"]) for r in mixing.with_copies(docs).collect()) == plain
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r[3] for r in plain)
    assert {r["size"] for r in mixed.collect()} <= {1}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    order = ["doc_id", "size", "source_size", "target", "taken"]
    found = queries.op3_source_mixing(spark, sf).select(order).orderBy("doc_id").collect()
    told = con.sql(f"SELECT {', '.join(order)} FROM ({queries.OP3_SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in found] == told


def test_a_caller_s_columns_stay(make, odd_rows, monkeypatch):
    docs = make(odd_rows).selectExpr("*", "1 AS _name0", "2 AS _None0", "3 AS _salt0", "4 AS _row")
    for most in (50_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        found = mixing.with_copies(docs)
        assert found.columns[:9] == docs.columns and {tuple(r)[5:9] for r in found.collect()} == {(1, 2, 3, 4)}
        assert mixing.mix(docs).columns == docs.columns
