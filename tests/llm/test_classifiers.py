import zlib

import numpy as np

from quern.llm import features, language, quality, queries


def crc(d):
    return zlib.crc32(str(d).encode() if d is not None else b"")


def test_ngram_counts_of_parts_and_blocks(monkeypatch):
    texts = [b"abcabc", b"", b"ab", b"xyzxyzxyzxyz"]
    whole = features.ngram_counts(texts, 64)
    monkeypatch.setattr(features, "PART", 4)
    assert np.array_equal(features.ngram_counts(texts, 64), whole)
    assert whole.sum(axis=1).tolist() == [4, 0, 0, 10]
    assert [(i, len(p)) for i, p in features.blocks(["abc", None, "defgh", "x"])] == [(0, 2), (2, 1), (3, 1)]
    assert list(features.blocks([])) == []


def test_recurrences_by_brute_force_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [b"abababab", b"", b"abc", b"aaaaaaaa", bytes(rng.integers(97, 99, 300, dtype=np.uint8)), b"x" * 40 + b"abcdefgh" * 9]
    for part, distances in ((2_000_000, 14), (7, 3), (64, 4)):
        monkeypatch.setattr(features, "PART", part)
        monkeypatch.setattr(features, "DISTANCES", distances)
        monkeypatch.setattr(features, "REACH", 2**distances)
        expected = np.zeros((len(texts), distances + 1))
        for i, text in enumerate(texts):
            for at in range(len(text) - 3):
                before = text.rfind(text[at : at + 4], 0, at + 3)
                near = before >= 0 and at - before < 2**distances
                expected[i, (at - before).bit_length() - 1 if near else distances] += 1
        assert np.array_equal(features.recurrences(texts), expected)


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 20)).astype(np.float32)
    y = x[:, 0] + 0.5 * x[:, 1] > 0.2
    w = language.linear_svm(x, y)
    assert ((np.hstack([x, np.ones((400, 1))]) @ w > 0) == y).mean() > 0.95


def test_held_out_languages(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op5_language(spark, sf).collect()
    assert {r["doc_id"] for r in found} == set(truth)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_languages_are_predicted_again_without_spark(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs.select("doc_id", "text", "lang").where(~language.held_out()))
    given = docs.collect()
    expected = {r["doc_id"]: p for r, p in zip(given, zip(*[[x for t in given for x in model.predict([t["text"]])[k]] for k in (0, 1)], strict=True), strict=True)}
    for r in queries.op5_language(spark, sf).collect():
        assert r["lang_pred"] == expected[r["doc_id"]][0] and abs(r["score"] - expected[r["doc_id"]][1]) < 1e-4


def test_sample_does_not_depend_on_partitions(make):
    rows = [(i, f"some text {i} {'the and' if i % 3 else 'der und'}", "en" if i % 3 else "de") for i in range(300)]
    models = [language.train(make(rows, parts=p), rows=60, per_language=40) for p in (1, 5)]
    assert np.array_equal(models[0].family_weights, models[1].family_weights)


def test_languages_of_odd_rows(make, odd_rows):
    docs = make(odd_rows, clashing=True)
    model = language.train(docs)
    found = language.identify(docs, model)
    assert [c for c in found.columns if c not in ("lang_pred", "score")] == docs.columns
    told = {str(r["doc_id"]): (r["lang_pred"], r["score"]) for r in found.collect()}
    assert all(told[d] == ("und", 0.0) for d in ("3", "4", "5", "8"))
    assert told["7"][0] == "de" and told["9"][0] == "fr"
    assert found.count() == len(odd_rows)
    kept = language.keep_identified(docs.where("doc_id < 6"))
    assert kept.columns == docs.columns
    assert language.identify(docs.limit(0), model).count() == 0
    assert language.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_one_language_and_unknown_codes(make):
    one = language.train(make([(i, f"text number {i} here", "xx") for i in range(9)]))
    assert {r["lang_pred"] for r in language.identify(make([(1, "anything")]), one).collect()} == {"xx"}


def test_sample_is_bounded(make):
    docs = make([(i, f"some text {i}", "en" if i % 3 else "de") for i in range(600)])
    drawn = features.bounded_sample(docs, "lang", 50, 80, ":x").groupBy("lang").count().collect()
    assert 40 <= sum(r["count"] for r in drawn) <= 110 and {r["lang"] for r in drawn} == {"en", "de"}


def test_held_out_quality(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.op10_quality(spark, sf).collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95


def test_quality_is_scored_again_by_brute_force(spark, sf):
    """Every document against every labelled vector, one by one in double precision."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out()))
    found = {r["doc_id"]: r["score"] for r in queries.op10_quality(spark, sf).collect()}
    labelled = model.vectors.astype(np.float64)
    for r in docs.collect():
        ((_, counts),) = quality._counts([r["text"]])
        latent = (quality._weigh(counts, model.idf) @ model.basis)[0].astype(np.float64)
        cosine = labelled @ (latent / max(np.linalg.norm(latent), 1e-12))
        near = sorted(range(len(cosine)), key=lambda i: -cosine[i])[: quality.NEIGHBOURS]
        weights = [max(cosine[i], 0) ** quality.SHARPNESS for i in near]
        expected = sum(w * model.labels[i] for w, i in zip(weights, near, strict=True)) / sum(weights) if sum(weights) else model.prior
        assert abs(found[r["doc_id"]] - expected) < 1e-3


def test_quality_of_odd_rows(spark, make, odd_rows):
    docs = make(odd_rows, clashing=True)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (8, 0, 0), (3, None, 0), (None, 1, 0), (77, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    found = quality.score(docs, model)
    rows = found.collect()
    assert len(rows) == len(odd_rows) and found.columns == [*docs.columns, "score"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (3, 4)} == {model.prior}
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
