"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import id_and_text, learns

SAMPLE = 12_000  # labelled rows a classifier is fitted on, at most


def learnable(labels: DataFrame, label: str, rest: int, parts: int) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from: one row for each document, 1 if any of its rows says 1."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
            .where(F.col("y").isin(0, 1) & learns(rest, parts)).groupBy("doc_id").agg(F.max("y").alias("y")))


def sample(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y): whole texts of at most ``most`` labelled documents, chosen by a hash of the id.

    The chosen ids are at most ``most`` rows, which is why they may be broadcast.
    """
    chosen = labelled.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(most)
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id")
