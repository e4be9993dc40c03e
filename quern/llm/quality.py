"""Quality scores by nearest labelled neighbours in a latent semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import crc32_of_id
from quern.llm.features import DISTANCES, blocks, bounded_sample, hash_digits, ngram_counts, recurrences, unit_rows

DIMS = 4096
#: The hashed n-grams, and the distances at which n-grams come again.
TERMS = DIMS + DISTANCES + 1
LATENT = 48
NEIGHBOURS = 25
#: Bounds of the labelled sample, of each label and in all; their whole texts are counted (16 KB a row).
SAMPLE_PER_LABEL = 1200
SAMPLE_ROWS = 3000
#: Likenesses are raised to this power before they weigh a label.
SHARPNESS = 4


@dataclass
class Neighbours:
    """What is broadcast: idf and projection (TERMS x LATENT), unit vectors of the labelled sample, their labels.

    At most SAMPLE_ROWS vectors of LATENT numbers and TERMS x (LATENT + 1) numbers, below 2 MB.
    """

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        latent = unit_rows(_weigh(counts, self.idf) @ self.basis)
        alike = latent @ self.vectors.T
        k = min(NEIGHBOURS, alike.shape[1])
        near = np.argpartition(-alike, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(alike, near, axis=1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        voted = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, np.clip(voted / np.where(total > 0, total, 1), 0, 1), self.prior)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Roots of each term's share of its text's terms, so that long texts weigh like short ones."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit_rows(_shares(counts) * idf)


def _counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    for start, part in blocks(texts):
        yield start, np.hstack([ngram_counts(part, DIMS), recurrences(part)])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, rows: int = SAMPLE_ROWS) -> Neighbours | None:
    """Learns from labels (doc_id, quality) of documents (doc_id, text); None if there are none.

    The sample of labels is bounded, so it is broadcast to the documents. Labels without a document, and null
    labels, are left out; a document of several labels counts with each. Latent axes are the leading
    singular vectors of the sample's weighted terms.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = bounded_sample(usable, "quality", per_label, rows, ":quality").orderBy(hash_digits(":quality"), "doc_id", "quality").limit(rows)
    pairs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for start, x in _counts(list(part["text"])):
                here = part.iloc[start : start + len(x)]
                yield pd.DataFrame({"doc_id": here["doc_id"], "quality": here["quality"], "x": [v.tobytes() for v in _shares(x).astype(np.float16)]})

    found = pairs.mapInPandas(count, "doc_id long, quality int, x binary").limit(2 * rows).toPandas()
    if found.empty:
        return None
    found = found.sort_values(["doc_id", "quality", "x"], kind="stable").head(2 * rows)
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float16).reshape(-1, TERMS).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    weighed = unit_rows(x * idf)
    probe = np.random.default_rng(42).standard_normal((TERMS, LATENT + 16)).astype(np.float32)
    for _ in range(4):
        probe = weighed.T @ np.linalg.qr(weighed @ probe)[0]
    basis = np.linalg.svd(probe, full_matrices=False)[0][:, :LATENT]
    labelled = found["quality"].to_numpy().astype(np.float32)
    return Neighbours(idf, basis, unit_rows(weighed @ basis), labelled, float(labelled.mean()))


def score(docs: DataFrame, model: Neighbours | None, keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) to the columns of docs, or to those in keep.

    The cosine to every labelled vector is computed, a block of documents at a time; the NEIGHBOURS nearest vote,
    weighed by likeness. Empty and null texts, and texts like none of the sample, get the sample's mean label;
    without a model all get 0.5. A column score in docs is replaced. Equal texts get equal scores but for rounding.
    """
    kept = [f.name for f in docs.schema if f.name != "score" and (keep is None or f.name in keep)]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.full(len(texts), 0.5)
            if sent.value is not None:
                for start, x in _counts([t if isinstance(t, str) else None for t in texts]):
                    out[start : start + len(x)] = sent.value.scores(x)
            yield pd.Series(out)

    told = F.pandas_udf(of, "double")
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept")).select("kept.*", told("text").alias("score"))


def held_out(modulus: int = 4, remainder: int = 2):
    return crc32_of_id() % modulus == remainder
