"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

1. A lexicon is learnt from a bounded sample of labelled documents: words, and beginnings of words of four to six
   letters, that toxic documents use far more often than others. Copies of one document would make all of its words
   look toxic, so a term must have been seen in enough different surroundings (its neighbouring words), and an exact
   binomial tail decides whether its share of toxic surroundings could be chance.
2. Features of each whole text: lexicon densities, how near hits are to words of the second person, capitals,
   punctuation and obfuscation rates, and the form of the text.
3. The sample is split in two. Each half is scored with a lexicon and trees of the other half; these scores, made on
   documents the model has not seen, fit the isotonic map from log odds to probability. The model that scores the table
   is fitted on the whole sample, with each half's features by the other half's lexicon.

Only ``SAMPLE`` documents at most (a parameter) are fitted on, on the driver; their term counts are Spark aggregates, of
which all terms go on that more toxic documents have than others: the sample bounds how many these are. Every document is
scored. Defined results: null and empty texts have no words and get the score of such a text; without learnable labels of
both kinds every score is 0. ``keep_clean`` decides row by row: ids may repeat or be null, and other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.boosting import BoostedTrees, Isotonic
from newsmood.llm.common import id_and_text, learns, map_batches, values, worker_cache
from newsmood.llm.labelled import SAMPLE, learnable, sample
from newsmood.llm.textstats import FORM, form
from newsmood.sources.shared import materialise

LEAST_SEEN = 3  # toxic surroundings of a term
CHANCE = 1e-4  # largest probability of as many toxic surroundings by chance
NEAR = 6  # words between a hit and a word of the second person
PREDICTED = 0.3
MEMO = 300_000
PREFIXES = (4, 5, 6)
#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro".split())

WORD = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_][\d@$*!|]+[^\W\d_]")
HITS = ["hits", "hit_density", "weight_density", "weight", "heaviest", "distinct_hits", "near_second_person",
        "second_person", "obfuscated"]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def terms_of(word: str) -> list[str]:
    """A word and, marked by a closing hyphen, its beginnings."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


class Lexicon(dict):
    """Weights of words, each found once: the largest weight among a word's terms."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = max(self.weights.get(t, 0.0) for t in terms_of(word))
        return value


def hit_features(text: str, lexicon: Lexicon) -> list[float]:
    """The numbers named in ``HITS``."""
    words = words_of(text)
    if not words:
        return [0.0] * len(HITS)
    n = len(words)
    weight = np.fromiter(map(lexicon.__getitem__, words), float, n)
    hits = np.flatnonzero(weight)
    second = np.flatnonzero(np.fromiter(map(SECOND_PERSON.__contains__, words), bool, n))
    near = 0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        right = second[np.minimum(at, len(second) - 1)]
        left = second[np.maximum(at - 1, 0)]
        near = int((np.minimum(np.abs(right - hits), np.abs(left - hits)) <= NEAR).sum())
    return [float(len(hits)), len(hits) / n, float(weight.sum()) / n, float(weight.sum()), float(weight.max()),
            float(len({words[i] for i in hits})), float(near), len(second) / n, len(OBFUSCATED.findall(text)) / n]


def features(text: str, lexicon: Lexicon) -> list[float]:
    return hit_features(text, lexicon) + form(text)


def _half(doc_id: pa.Array) -> list[int]:
    return [hash((i, 1)) & 1 for i in doc_id.to_pylist()]


def count_terms(some: DataFrame) -> pd.DataFrame:
    """term, toxic0, clean0, toxic1, clean1: documents of each half with each term, for the terms that enough toxic
    documents have, and more of them than of others.

    ``some``: doc_id, text, y. Counts are added up within a map task before they are shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], Counter] = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}
        for batch in batches:
            for half, text, y in zip(_half(batch.column(0)), values(batch.column(1)),
                                     batch.column(2).to_pylist(), strict=True):
                counts[half, y].update({t for w in set(words_of(text)) for t in terms_of(w)})
        for half in (0, 1):
            terms = list(counts[half, 0].keys() | counts[half, 1].keys())
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms), pa.array([half] * len(terms), pa.int32()),
                     pa.array([counts[half, 1][t] for t in terms], pa.int64()),
                     pa.array([counts[half, 0][t] for t in terms], pa.int64())], ["term", "half", "toxic", "clean"])

    every = some.mapInArrow(run, "term string, half int, toxic long, clean long")
    summed = every.groupBy("term").agg(*[
        F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}")
        for h in (0, 1) for c in ("toxic", "clean")])
    toxic, clean = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    return summed.where((toxic >= LEAST_SEEN) & (toxic > clean)).toPandas()


def count_surroundings(some: DataFrame, terms: set[str]) -> pd.DataFrame:
    """term, toxic0, clean0, toxic1, clean1: different surroundings of each term in the documents of each half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for half, text, y in zip(_half(batch.column(0)), values(batch.column(1)),
                                     batch.column(2).to_pylist(), strict=True):
                words = ["", *words_of(text), ""]
                known: dict[str, list[str]] = {}
                for i in range(1, len(words) - 1):
                    w = words[i]
                    if w not in known:
                        known[w] = [t for t in terms_of(w) if t in terms]
                    for t in known[w]:
                        found.add((t, half, y, f"{words[i - 1]} {words[i + 1]}"))
            if found:
                term, half, y, around = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term), pa.array(half, pa.int32()), pa.array(y, pa.int32()), pa.array(around)],
                    ["term", "half", "y", "around"])

    each = some.mapInArrow(run, "term string, half int, y int, around string").distinct()
    return each.groupBy("term").agg(*[
        F.count(F.when((F.col("half") == h) & (F.col("y") == y), 1)).alias(f"{name}{h}")
        for h in (0, 1) for y, name in ((1, "toxic"), (0, "clean"))]).toPandas()


def _log_tail(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Upper bound of log P(Binomial(n, p) >= k) for k / n > p (Chernoff)."""
    share = np.clip(k / n, 1e-12, 1 - 1e-12)
    return -n * (share * np.log(share / p) + (1 - share) * np.log((1 - share) / (1 - p)))


def weights(seen: pd.DataFrame, halves: list[int], prior: float) -> dict[str, float]:
    """Log odds of toxic surroundings against the share of toxic documents, of the terms beyond chance."""
    toxic = sum(seen[f"toxic{h}"] for h in halves).to_numpy(float)
    n = toxic + sum(seen[f"clean{h}"] for h in halves).to_numpy(float)
    keep = (toxic >= LEAST_SEEN) & (toxic / np.maximum(n, 1) > max(0.5, prior))
    keep[keep] = _log_tail(toxic[keep], n[keep], prior) < np.log(CHANCE)
    odds = np.log((toxic + 0.5) / (n - toxic + 0.5)) - np.log(prior / (1 - prior))
    return dict(zip(seen.term[keep], odds[keep].tolist(), strict=True))


def _sample_features(some: DataFrame, lexicons: list[dict[str, float]]) -> pd.DataFrame:
    """doc_id, half, y, x: a half's features are by the lexicon of the other half."""
    def make():
        own = worker_cache(object(), lambda: [Lexicon(w) for w in lexicons])

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            half = _half(batch.column(0))
            rows = [features(t, own[1 - h]) for t, h in zip(values(batch.column(1)), half, strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(half, pa.int32()), batch.column(2),
                 pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "half", "y", "x"])

        return each

    return map_batches(some, make, "doc_id long, half int, y int, x array<double>").toPandas().sort_values("doc_id")


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; the log odds order what the steps of the isotonic map leave equal."""
        margin = self.trees.margin(x)
        return 0.99 * self.calibration(margin) + 0.01 / (1 + np.exp(-margin))


def fit(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE) -> Model | None:
    some = materialise(sample(docs, labelled, most).select("doc_id", "text", "y"), "labelled")
    prior = some.agg(F.avg("y")).first()[0]
    if prior is None or prior in (0, 1):
        return None
    terms = count_terms(some)
    seen = count_surroundings(some, set(terms.term)) if len(terms) else pd.DataFrame(
        {"term": [], "toxic0": [], "clean0": [], "toxic1": [], "clean1": []})
    rows = _sample_features(some, [weights(seen, [0], prior), weights(seen, [1], prior)])
    x, y, half = np.array(rows.x.tolist()), rows.y.to_numpy(float), rows.half.to_numpy()
    margin = np.zeros(len(y))
    for h in (0, 1):
        if (half == h).any() and (half != h).any():
            margin[half == h] = BoostedTrees(x[half != h], y[half != h]).margin(x[half == h])
    return Model(weights(seen, [0, 1], prior), BoostedTrees(x, y), Isotonic(margin, y))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", rest: int = 2, parts: int = 4,
          most: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, learnable(labels, label, rest, parts), most)

    def make():
        lexicon = worker_cache(object(), lambda: Lexicon(model.lexicon)) if model else None

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.zeros(batch.num_rows)
            if model:
                found = model.probability(np.array([features(t, lexicon) for t in values(batch.column(1))]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

        return each

    return (map_batches(id_and_text(docs), make, "doc_id long, score double")
            .select("doc_id", (~learns(rest, parts)).alias("held_out"), "score",
                    (F.col("score") >= PREDICTED).cast("int").alias("predicted")))


def keep_clean(docs: DataFrame, labels: DataFrame, label: str = "toxic", rest: int = 2, parts: int = 4,
               most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with the columns they came with, in one pass over them."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(named, learnable(labels, label, rest, parts), most)
    at = docs.columns.index(text_col)

    def make():
        lexicon = worker_cache(object(), lambda: Lexicon(model.lexicon))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t or "", lexicon) for t in values(batch.column(at))])
            return batch.filter(pa.array(model.probability(x) < PREDICTED))

        return each

    return map_batches(docs, make, docs.schema) if model else docs
