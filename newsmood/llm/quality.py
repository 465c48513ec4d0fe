"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in its features (the form of the text: lengths, repeats, capitals, signs, entropy; each
also squared). For a pair of documents of which the first is preferred, the model says with which probability it is:
the logistic function of the difference of strengths. The weights minimise the logistic loss on feature differences
over all pairs of one labelled 1 with one labelled 0. The sums over pairs are taken apart: with the probabilities of a
block of pairs as a matrix, slope and bend follow from its row and column sums and its product with the features, so no
difference is formed.

Fitted on at most ``SAMPLE`` labelled documents (a parameter), on the driver; every document is scored.
The threshold is the score quantile, over all rows that may be learnt from, at the share of label 0 among them; scores
are logistic in the distance from it and are 0.3 there.

Defined results: null and empty texts have a score like any other; without learnable labels of both kinds every score
is 0.5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import id_and_text, learns, map_batches, values
from newsmood.llm.labelled import SAMPLE, learnable, sample
from newsmood.llm.textstats import FORM, form
from newsmood.sources.shared import materialise

BLOCK = 512  # documents labelled 1 that are paired with all others at a time
RIDGE = 1e-3
AT_THRESHOLD = 0.3


def _features(docs: DataFrame, extra: str = "") -> DataFrame:
    """(doc_id, x, ...): the features of each text."""
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [form(t) for t in values(batch.column(1))]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64())), *batch.columns[2:]],
                ["doc_id", "x", *batch.schema.names[2:]])

        return each

    return map_batches(docs, make, "doc_id long, x array<double>" + extra)


def pair_sums(good: np.ndarray, bad: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and second derivative of the logistic loss, summed over all pairs of a good and a bad row."""
    slope, bend = np.zeros(len(weights)), np.zeros((len(weights), len(weights)))
    down = bad @ weights
    for at in range(0, len(good), BLOCK):
        some = good[at:at + BLOCK]
        p = 1 / (1 + np.exp(np.clip((some @ weights)[:, None] - down, -30, 30)))  # how wrong the model is about each pair
        slope -= some.T @ p.sum(axis=1) - bad.T @ p.sum(axis=0)
        v = p * (1 - p)
        cross = some.T @ (v @ bad)
        bend += (some * v.sum(axis=1)[:, None]).T @ some + (bad * v.sum(axis=0)[:, None]).T @ bad - cross - cross.T
    return slope, bend


class BradleyTerry:
    """``strength`` of feature rows, fitted on pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._wide(x)
        good, bad = z[y == 1], z[y == 0]
        self.weights = np.zeros(z.shape[1])
        for _ in range(25):  # Newton's method on the mean logistic loss with a ridge
            slope, bend = pair_sums(good, bad, self.weights)
            pairs = len(good) * len(bad)
            step = np.linalg.solve(bend / pairs + RIDGE * np.eye(len(slope)), slope / pairs + RIDGE * self.weights)
            self.weights -= step
            if np.abs(step).max() < 1e-6:
                break

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z])

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self._wide(x) @ self.weights


def fit(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE) -> BradleyTerry | None:
    rows: pd.DataFrame = _features(sample(docs, labelled, most), ", y int").select("doc_id", "x", "y").toPandas()
    rows = rows.sort_values("doc_id")
    if rows.y.nunique() < 2:
        return None
    return BradleyTerry(np.array(rows.x.tolist()).reshape(-1, len(FORM)), rows.y.to_numpy())


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", rest: int = 0, parts: int = 5,
          most: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, strength."""
    labelled = learnable(labels, label, rest, parts)
    model = fit(docs, labelled, most)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([form(t) for t in values(batch.column(1))])
            strength = model.strength(x) if model else np.zeros(len(x))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(strength)], ["doc_id", "strength"])

        return each

    scored = materialise(map_batches(id_and_text(docs), make, "doc_id long, strength double"), "strengths")
    share = labelled.agg(F.avg(1 - F.col("y"))).first()[0]
    line = 0.0
    if model is not None:
        known = scored.join(labelled, "doc_id")
        line = known.agg(F.percentile_approx("strength", F.lit(share), 10_000)).first()[0]
    shift = float(np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))) - line if model is not None else 0.0
    value = 1 / (1 + F.exp(-(F.col("strength") + shift)))
    return scored.select("doc_id", (~learns(rest, parts)).alias("held_out"), value.alias("score"), "strength").select(
        "doc_id", "held_out", "score", (F.col("score") >= AT_THRESHOLD).cast("int").alias("predicted"), "strength")
