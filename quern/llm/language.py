"""Language identification in two steps: the family, then duels of linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import crc32_of_id
from quern.llm.features import blocks, bounded_sample, hash_digits, ngram_counts, unit_rows

#: Families of languages by ISO 639-1 code. Any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

DIMS = 4096
#: Bounds of the training sample, all languages together and for each; their whole texts are counted.
SAMPLE_ROWS = 4000
SAMPLE_PER_LANGUAGE = 400
UNKNOWN = "und"

_letter = regex.compile(r"\p{L}").search


def language_features(texts: list[str | None]) -> np.ndarray:
    counts = np.concatenate([ngram_counts(part, DIMS) for _, part in blocks([(t or "").lower() for t in texts])])
    return unit_rows(np.sqrt(counts))


def linear_svm(x: np.ndarray, positive: np.ndarray, cost: float = 4.0, rounds: int = 80) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge support vector machine, by accelerated gradient steps.

    Both classes weigh the same in all, whatever their numbers.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    each = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32) * np.float32(cost)
    step = np.float32(1.0 / (1.0 / cost + 2.0 * np.sum(each * np.einsum("ij,ij->i", x, x))))
    w = np.zeros(x.shape[1], np.float32)
    ahead = w
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead / np.float32(cost) - 2 * ((each * y * slack) @ x))
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray  # a column for each family against the rest
    members: dict[str, list[str]]
    duels: dict[str, tuple[list[tuple[int, int]], np.ndarray]]  # by family: pairs of members, a column of weights each

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        x = language_features(texts)
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        margins = np.clip(x @ self.family_weights, -8, 8)
        chance = 1 / (1 + np.exp(-4 * margins))
        chance /= chance.sum(axis=1, keepdims=True)
        pick = chance.argmax(axis=1)
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(pick == f)
            members = self.members[family]
            votes = np.ones((len(rows), len(members)))
            pairs, weights = self.duels[family]
            if pairs and len(rows):
                won = 1 / (1 + np.exp(-4 * np.clip(x[rows] @ weights, -8, 8)))
                votes = np.zeros((len(rows), len(members)))
                for k, (i, j) in enumerate(pairs):
                    votes[:, i] += won[:, k]
                    votes[:, j] += 1 - won[:, k]
                votes /= len(members) - 1
            for row, vote in zip(rows, votes, strict=True):
                if texts[row] and _letter(texts[row]):
                    best = int(vote.argmax())
                    names[row], scores[row] = members[best], float(min(1.0, chance[row, f] * vote[best]))
        return names, scores


def train(labelled: DataFrame, rows: int = SAMPLE_ROWS, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Learns from (doc_id, text, lang); rows without text, letters or lang are left out. None if none is left.

    Only the bounded sample's counts (16 KB a row) come to the driver.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"lang": part["lang"], "order": part["order"], "x": [v.astype(np.float32).tobytes() for v in language_features(list(part["text"]))]})

    sample = bounded_sample(usable, "lang", per_language, rows, ":language").select("text", "lang", hash_digits(":language").alias("order"))
    found = sample.mapInPandas(count, "lang string, order string, x binary").limit(2 * rows).toPandas()
    if found.empty:
        return None
    found = found.sort_values(["order", "lang", "x"], kind="stable").head(rows).sort_values(["lang", "x"], kind="stable")
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float32).reshape(-1, DIMS)
    lang = found["lang"].to_numpy()
    family = np.array([FAMILY_OF.get(v, v) for v in lang], dtype=object)
    families = sorted(set(family))
    against = [linear_svm(x, family == f) for f in families] if len(families) > 1 else [np.zeros(DIMS + 1)]
    members = {f: sorted(set(lang[family == f])) for f in families}
    duels = {}
    for f in families:
        pairs = list(combinations(range(len(members[f])), 2))
        fitted = []
        for i, j in pairs:
            both = (lang == members[f][i]) | (lang == members[f][j])
            fitted.append(linear_svm(x[both], lang[both] == members[f][i]))
        duels[f] = pairs, np.array(fitted, dtype=np.float32).T
    return Model(families, np.array(against, dtype=np.float32).T, members, duels)


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to the columns of docs, or to those in keep; same-named ones are replaced.

    Only the text is looked at, all of it. Null texts and texts without a letter are ``und`` with score 0, as is
    everything if there is no model. Rows that repeat get the same answer; ties go to the first name.
    """
    kept = [f for f in docs.schema if f.name not in ("lang_pred", "score") and (keep is None or f.name in keep)]
    docs = docs.select("text", F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            values = [t if isinstance(t, str) else None for t in batch]
            if sent.value is None or not values:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(values), "score": [0.0] * len(values)})
                continue
            names, scores = [], []
            for start, part in blocks(values):
                n, s = sent.value.predict(values[start : start + len(part)])
                names += n
                scores += s
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    told = F.pandas_udf(of, "lang_pred string, score double")
    return docs.withColumn("told", told("text")).select("kept.*", "told.*")


def held_out(modulus: int = 5):
    return crc32_of_id() % modulus == 0


def keep_identified(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The documents that get a language with a score of ``least`` or more, with the columns of docs.

    The model learns from the documents' own lang (held-out ids left out); without any, all documents are rejected.
    """
    model = train(docs.where(~held_out()))
    told = identify(docs.select("text", F.struct("*").alias("_row")), model, keep=["_row"])
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")
