"""Label counts: tallies of the fact table and the counts rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.constants import CLASSIFIER, LABELS, LEXICON
from newsmood.functions.sentiment import model_label, tally


def with_label(scored: DataFrame) -> DataFrame:
    return scored.withColumn(
        "label", model_label(F.col("model"), F.col("neg"), F.col("positive"), F.col("compound")))


def tally_labels(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Label counts of the long fact per key; a row per model when ``model`` is a key."""
    lab = model_label(F.col("model"), F.col("neg"), F.col("positive"), F.col("compound"))
    return scored.groupBy(*keys).agg(*tally(lab))


def label_counts(scored: DataFrame, day: Column | None = None, subject: str | None = None,
                 scope: str | None = None) -> DataFrame:
    """Six counts, three labels for each of the two models, of one day and subject or of everything.

    ``scored`` is the fact, whose headlines carry all subjects they hold.
    """
    rows = scored
    if day is not None:
        rows = rows.where(F.col("day") == day)
    if subject is not None:
        rows = rows.where(F.array_contains("subjects", subject))
    if scope is not None:
        rows = rows.where(F.col("scope") == scope)
    lab = model_label(F.col("model"), F.col("neg"), F.col("positive"), F.col("compound"))
    return rows.agg(*[
        F.count_if((F.col("model") == model) & (lab == name)).alias(f"{model}_{name}")
        for model in (LEXICON, CLASSIFIER) for name in LABELS])


def average_scores(wide: DataFrame, lexicon: str = "lexicon", classifier: str = "classifier") -> DataFrame:
    """Mean scores of both models, and the tanh of the classifier's mean negative less mean positive share.

    The sign is the other way round than in ``polarity``; kept as the query is defined.
    """
    fields = ["neg", "neu", "pos"]
    means = [F.avg(F.col(f"{lexicon}.{f}")).alias(f"lexicon_{f}") for f in [*fields, "compound"]]
    means += [F.avg(F.col(f"{classifier}.{f}")).alias(f"classifier_{f}") for f in fields]
    swing = F.tanh(F.avg(F.col(f"{classifier}.neg")) - F.avg(F.col(f"{classifier}.pos")))
    return wide.agg(*means, swing.alias("classifier_polarity"))
