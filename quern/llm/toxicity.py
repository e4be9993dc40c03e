"""Toxicity by terms and their misspellings, weighed by whether the words around them quote or abuse."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quern.llm.bpe import own_texts, slices
from quern.llm.common import crc32_of_id, give_back, materialize
from quern.llm.features import bounded_sample, hash_digits

#: Bounds of the labelled sample, of each label and in all, and of the terms learned from it.
SAMPLE_PER_LABEL = 3000
SAMPLE_ROWS = 6000
MOST_TERMS = 300
MOST_CANDIDATES = 20_000
#: A beginning of words is a candidate with so many letters; the whole word always is.
BEGINNINGS = range(4, 11)
#: Least likelihood ratio (chi square of one degree) and least share of toxic documents of a term, as in the whole of the labels.
SURE = 25.0
SHARE = 0.8
#: Letters of a term from which one edit, and from which two, are forgiven.
ONE_EDIT, TWO_EDITS = 5, 9
#: Words before and after a term that are its context, and bytes of text that are read together.
WINDOW = 12
TEXT_BYTES = 4_000_000
REMEMBERED = 200_000
END = "$"

#: Words that report what others say, in English, French, German and Spanish.
REPORTS = """said says called calling wrote written word words term quote quoted quotes insult insults slur reported mot mots terme dit appelé insulte insultes citation
sagte nannte genannt wort wörter begriff zitat beleidigung palabra palabras dijo llamó insulto insultos cita término""".split()  # fmt: skip
_QUOTES = r'["“”„«»]'
_MARKS = r"[.,;:!?()\[\]{}<>|/]+"
_TRIM = "'*_-’‘"


@dataclass
class _Tokens:
    """Words of a slice of texts, lower-cased; ``word`` has their numbers, and a quotation mark is a word of its own."""

    word: np.ndarray
    doc: np.ndarray
    words: list[str]
    array: pa.Array


def _read(texts: pa.Array) -> _Tokens:
    low = pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(own_texts(texts)), _QUOTES, ' " '), _MARKS, " ")
    split = pc.ascii_split_whitespace(low)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(split.offsets.to_numpy()))
    coded = split.values.dictionary_encode()
    trimmed = pc.utf8_trim(coded.dictionary, characters=_TRIM).dictionary_encode()
    word = trimmed.indices.to_numpy().astype(np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    words = trimmed.dictionary.to_pylist()
    full = np.array([w != "" for w in words], bool)[word] if len(word) else np.zeros(0, bool)
    return _Tokens(word[full], doc[full], words, trimmed.dictionary)


class Automaton:
    """A trie of terms, and the Levenshtein automaton of a word run along it.

    A term that ends in END is a whole word, another the beginning of one. Terms of ONE_EDIT letters forgive one insertion,
    deletion or replacement, those of TWO_EDITS two.
    """

    def __init__(self, terms: list[str]):
        self.terms = [t.removesuffix(END) for t in terms]
        self.whole = [t.endswith(END) for t in terms]
        self.edits = [(len(t) >= ONE_EDIT) + (len(t) >= TWO_EDITS) for t in self.terms]
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most: list[int] = [0]
        for k, t in enumerate(self.terms):
            at = 0
            self.most[0] = max(self.most[0], self.edits[k])
            for c in t:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.next[at][c]
                self.most[at] = max(self.most[at], self.edits[k])
            self.ends[at].append(k)
        #: Of a term in one piece more than its edits, one stays whole and moves no further than these: (piece, first and last place, term).
        self.pieces: list[tuple[str, int, int, int]] = []
        for k, (t, edits) in enumerate(zip(self.terms, self.edits, strict=True)):
            cuts = [len(t) * i // (edits + 1) for i in range(edits + 2)]
            self.pieces += [(t[i:j], max(0, i - edits), i + edits, k) for i, j in zip(cuts, cuts[1:], strict=False)]
        self.parts: dict[tuple[int, ...], Automaton] = {}

    @property
    def maybe(self) -> str:
        """A pattern that every word that matches has."""
        found = {f".{{{low},{high}}}{re.escape(piece)}" for piece, low, high, _ in self.pieces}
        return f"(?s)^(?:{'|'.join(sorted(found))})" if found else "^[^\\x00-\\x{10FFFF}]"

    def nearest(self, word: str) -> tuple[int, int] | None:
        """As :meth:`match`, run along the terms only of which the word has a piece."""
        few = tuple(sorted({k for piece, low, high, k in self.pieces if word.find(piece, low, high + len(piece)) >= 0}))
        if not few:
            return None
        if few not in self.parts:
            if len(self.parts) > 1000:
                self.parts.clear()
            self.parts[few] = Automaton([self.terms[k] + END * self.whole[k] for k in few])
        found = self.parts[few].match(word)
        return found and (few[found[0]], found[1])

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, the longest of several; None if there is none."""
        best: tuple[int, int, int] | None = None
        todo = [(0, self._closed({0: 0}, word, self.most[0]))]
        while todo:
            node, states = todo.pop()
            for k in self.ends[node]:
                e = states.get(len(word)) if self.whole[k] else min(states.values())
                if e is not None and e <= self.edits[k]:
                    mine = (e, -len(self.terms[k]), k)
                    best = mine if best is None or mine < best else best
            for c, child in self.next[node].items():
                after: dict[int, int] = {}
                most = self.most[child]
                for i, e in states.items():
                    if i < len(word):
                        cost = e + (word[i] != c)
                        if cost <= min(most, after.get(i + 1, most)):
                            after[i + 1] = cost
                    if e + 1 <= min(most, after.get(i, most)):
                        after[i] = e + 1
                if after:
                    todo.append((child, self._closed(after, word, most)))
        return None if best is None else (best[2], best[0])

    @staticmethod
    def _closed(states: dict[int, int], word: str, most: int) -> dict[int, int]:
        """With the states that are reached by leaving out letters of the word."""
        for i in range(min(states), len(word)):
            if i in states and states[i] < most and states[i] + 1 < states.get(i + 1, most + 1):
                states[i + 1] = states[i] + 1
        return states


@dataclass
class Toxicity:
    """What is broadcast: at most MOST_TERMS terms, words near them that are others (MOST_CANDIDATES at most), and weights of the features."""

    terms: list[str]
    others: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    prior: float = 0.0
    automaton: Automaton = field(init=False)

    def __post_init__(self):
        self.automaton = Automaton(self.terms)

    def hits(self, tokens: _Tokens, known: dict[str, tuple[int, int] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, terms, edits) of the words that match."""
        maybe = pc.match_substring_regex(tokens.array, self.automaton.maybe).to_numpy(zero_copy_only=False)
        term, edits = np.full(len(tokens.words) + 1, -1, np.int64), np.zeros(len(tokens.words) + 1, np.int64)
        for i in np.flatnonzero(maybe).tolist():
            word = tokens.words[i]
            if word not in known:
                if len(known) > REMEMBERED:
                    known.clear()
                known[word] = self.automaton.nearest(word)
            if known[word] is not None and not (known[word][1] and word in self.others):
                term[i], edits[i] = known[word]
        at = np.flatnonzero(term[tokens.word] >= 0)
        return at, term[tokens.word[at]], edits[tokens.word[at]]

    def features(self, tokens: _Tokens, n: int, known: dict[str, tuple[int, int] | None]) -> np.ndarray:
        """A row for each of n texts, of logarithms of counts: terms as they are and misspelled, used and quoted, the most that stand together, different ones, and their share of words.

        A term is quoted between quotation marks no further than WINDOW words away, or if a word that reports stands as near before it.
        """
        at, term, edits = self.hits(tokens, known)
        doc = tokens.doc[at]
        starts = np.searchsorted(tokens.doc, np.arange(n + 1))
        low, high = np.maximum(at - WINDOW, starts[doc]), np.minimum(at + WINDOW + 1, starts[doc + 1])
        number = {w: i for i, w in enumerate(tokens.words)}
        count = lambda words: np.append(0, np.cumsum(np.isin(tokens.word, [number[w] for w in words if w in number])))
        quotes, reports = count(['"']), count(REPORTS)
        inside = ((quotes[at] - quotes[starts[doc]]) % 2 == 1) & (quotes[at] > quotes[low]) & (quotes[high] > quotes[at])
        quoted = inside | (reports[at] > reports[low])
        crowd = np.searchsorted(at, high) - np.searchsorted(at, low)
        tally = lambda mask: np.bincount(doc[mask], minlength=n).astype(float)
        out = [np.ones(n)] + [np.log1p(tally((edits > 0) == e) if q is None else tally(((edits > 0) == e) & (quoted == q))) for e in (False, True) for q in (False, True)]
        most = np.zeros(n)
        np.maximum.at(most, doc, np.where(quoted, 0, crowd))
        kinds = np.unique(doc * np.int64(max(1, len(self.terms))) + term) // max(1, len(self.terms))
        share = 100 * tally(~quoted) / np.maximum(1, np.diff(starts))
        return np.stack([*out, np.log1p(most), np.log1p(np.bincount(kinds, minlength=n)), np.log1p(share)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.weights is None else 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _beginnings(words: list[str]) -> set[str]:
    return {w[:k] for w in words for k in BEGINNINGS if len(w) >= k} | {w + END for w in words if len(w) > 2 and w != '"'}


def _over_texts(rows: DataFrame, of: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                yield of(part)
            give_back()

    return rows.mapInArrow(each, schema)


def _counted(sample: DataFrame, terms_of: Callable[[_Tokens, int, dict], list[set[str]]]) -> DataFrame:
    """(term, n, t): documents of the sample, and toxic ones, that have what ``terms_of`` makes of the words of each."""
    known: dict[str, tuple[int, int] | None] = {}  # a task has its own

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        n: dict[str, int] = defaultdict(int)
        t: dict[str, int] = defaultdict(int)
        for terms, toxic in zip(terms_of(_read(part.column("text")), len(part), known), part.column("toxic").to_pylist(), strict=True):
            for term in terms:
                n[term] += 1
                t[term] += toxic
        return pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(n.values(), pa.int64()), pa.array([t[k] for k in n], pa.int64())], names=["term", "n", "t"])

    return _over_texts(sample, of, "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _beginnings_of(tokens: _Tokens, n: int, _: dict) -> list[set[str]]:
    starts = np.searchsorted(tokens.doc, np.arange(n + 1))
    return [_beginnings([tokens.words[k] for k in np.unique(tokens.word[i:j])]) for i, j in zip(starts, starts[1:], strict=False)]


def choose_terms(found: dict[str, tuple[float, float]]) -> list[str]:
    """Terms from the (clean, toxic) counts of candidates: beginnings and whole words whose share of toxic ones is SHARE or more.

    From the shortest on, a beginning gives way to longer ones as long as one of them keeps 97 % of its toxic documents.
    """
    share = lambda t: found[t][1] / (found[t][0] + found[t][1] + 0.5)
    good = {t for t in found if share(t) >= SHARE}
    longer: dict[str, list[str]] = defaultdict(list)
    top = []
    for t in sorted(good):
        parents = [t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in good]
        (longer[parents[0]] if parents else top).append(t)

    def kept(t: str) -> list[str]:
        if any(found[x][1] >= 0.97 * found[t][1] for x in longer[t]):
            return [y for x in longer[t] if found[x][1] >= 0.3 * found[t][1] for y in kept(x)]
        return [t]

    chosen = [y for t in top for y in kept(t)]
    return sorted(sorted(chosen, key=lambda t: (-found[t][1], t))[:MOST_TERMS])


def _one_each(sample: DataFrame, runs: int = 3, n: int = 4) -> DataFrame:
    """One of each group of copies and near copies of the sample: of rows of a label that share the least seeded hash over their runs of n words, one seed after the other.

    A text that is copied a thousand times says no more about its words than one.
    """
    for seed in range(runs):
        words = F.split(F.trim("text"), r"\s+")
        shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, n), F.lit(seed)))
        keyed = sample.withColumn("w", words).select("toxic", "text", F.array_min(shingles).alias("key"))
        sample = keyed.groupBy("toxic", "key").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")
    return sample


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, rows: int = SAMPLE_ROWS) -> Toxicity:
    """Learns terms and weights from labels (doc_id, toxic) of documents (doc_id, text).

    The sample is bounded, copies and near copies count once, and counts are carried up to all labels. Labels without a document, and null ones, are left out; a document of several labels
    counts with each. Terms are beginnings of words and words that toxic documents have far more often than others;
    words within their edits that clean documents of the sample have are no misspellings. Without labels all scores are 0, without toxic ones or clean ones their mean.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = bounded_sample(usable, "toxic", per_label, rows, ":toxic").orderBy(hash_digits(":toxic"), "doc_id", "toxic").limit(rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = materialize(_one_each(sample))
    all_of = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    here = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = all_of.get(1, 0) / max(1, sum(all_of.values()))
    if not here.get(0) or not here.get(1):
        return Toxicity([], prior=prior)
    up = {k: all_of[k] / here[k] for k in (0, 1)}
    counted = _counted(sample, _beginnings_of)
    clean, toxic = F.lit(here[0]), F.lit(here[1])
    c, t = F.col("n") - F.col("t"), F.col("t")
    part = lambda k, rest: F.when(k > 0, k * F.log(k / (F.col("n") * rest / (clean + toxic)))).otherwise(0.0)
    sure = counted.where((t / toxic > c / clean) & (2 * (part(t, toxic) + part(c, clean)) >= SURE) & (up[1] * t >= 0.5 * up[0] * c))
    found = {r["term"]: (up[0] * (r["n"] - r["t"]), up[1] * r["t"]) for r in sure.orderBy(F.desc("t"), "term").limit(MOST_CANDIDATES).collect()}
    model = Toxicity(choose_terms(found), prior=prior)
    if not model.terms:
        return model
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def misspelled(tokens: _Tokens, n: int, known: dict) -> list[set[str]]:
        at, _, edits = sent.value.hits(tokens, known)
        found: list[set[str]] = [set() for _ in range(n)]
        for i in at[edits > 0].tolist():
            found[tokens.doc[i]].add(tokens.words[tokens.word[i]])
        return found

    near = _counted(sample, misspelled).where(F.col("n") > F.col("t")).orderBy(F.desc("n"), "term").limit(MOST_CANDIDATES).collect()
    model = Toxicity(model.terms, frozenset(r["term"] for r in near if up[1] * r["t"] < up[0] * (r["n"] - r["t"]) * 4), prior=prior)
    told = _features(sample, model, ["toxic"]).limit(2 * rows).toPandas()
    told = told.sort_values(["toxic", "x"], kind="stable")
    x = np.frombuffer(b"".join(told["x"]), "<f8").reshape(len(told), -1)
    y = told["toxic"].to_numpy(float)
    model.weights = _logistic(x, y, np.where(y > 0, up[1], up[0]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small quadratic penalty, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], 0.05)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty), slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def _features(rows: DataFrame, model: Toxicity, keep: list[str]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)
    known: dict[str, tuple[int, int] | None] = {}  # a task has its own

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        x = sent.value.features(_read(part.column("text")), len(part), known)
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array([v.astype("<f8").tobytes() for v in x], pa.binary())], names=[*keep, "x"])

    return _over_texts(rows.select(*keep, "text"), of, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", x binary")


def score(docs: DataFrame, model: Toxicity, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs (text, ...) and score, from 0 to 1, higher: label 1 likelier.

    Every row is scored by its whole text; null and empty texts have no term. Rows with equal texts have equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f"`{c}`" for c in keep if c != "score"]

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, int] | None] = {}
        for texts in batches:
            batch, out = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], names=["text"]), []
            for part in slices(batch, "text", TEXT_BYTES):
                out.append(sent.value.scores(sent.value.features(_read(part.column("text")), len(part), known)))
            yield pd.Series(np.concatenate([*out, np.empty(0)]))
            give_back()

    told = F.pandas_udf(of, "double")
    return docs.select("text", F.struct(*kept).alias("kept")).select("kept.*", told("text").alias("score"))


def held_out(modulus: int = 5, remainder: int = 0):
    return crc32_of_id() % modulus == remainder
