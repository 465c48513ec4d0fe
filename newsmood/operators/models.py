"""Hook for a user-supplied classifier.

The engine batches, places and post-processes; the model is a function from a batch of titles to class scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from newsmood.functions.sentiment import class_compound, label, polarity, softmax
from newsmood.functions.text import mask_handles
from newsmood.operators.skew import SALTS, spread_join
from newsmood.sources.shared import materialise
from newsmood.sources.writers import append_missing


def classify(df: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], text: str = "title",
             batch_size: int = 150, mask: bool = False) -> DataFrame:
    """Adds ``neg, neu, positive, compound, label`` from a three-class model.

    ``make_scorer()`` loads the model once per Python worker and returns ``scores(titles) -> (n, 3)`` raw class
    scores in the order negative, neutral, positive. Rows are scored where they are; nothing is shuffled.
    """
    raw = predict_batch_udf(make_scorer, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    source = mask_handles(F.col(text)) if mask else F.col(text)
    return with_class_scores(df.withColumn("__raw", raw(source)), "__raw").drop("__raw")


SCORES = "digest string, raw array<double>, bucket string"


def classify_once(df: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], path: str,
                  by: list[str], text: str = "title", batch_size: int = 150, salts: int = SALTS) -> DataFrame:
    """As ``classify``, but the model sees each different text once, in this run and later ones.

    Scores are stored under ``path`` by a digest of the text. Texts that are not there yet go to the model ordered by
    length within their partition, so that those of a batch are of like length. Null texts are not scored. The join back
    is salted by ``by``, columns that tell rows of a hot text apart.
    """
    spark = df.sparkSession
    spark.createDataFrame([], SCORES).write.mode("append").partitionBy("bucket").parquet(path)  # the table is there
    stored = spark.read.schema(SCORES).parquet(path)
    keyed = df.withColumn("__digest", F.sha2(F.col(text), 256))
    unseen = (keyed.where(F.col(text).isNotNull()).groupBy(F.col("__digest").alias("digest")).agg(F.min(text).alias("text"))
              .join(stored.select("digest"), "digest", "left_anti")
              .withColumn("chars", F.length("text")).sortWithinPartitions("chars", "digest"))
    raw = predict_batch_udf(make_scorer, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    scored = unseen.select("digest", raw(F.col("text")).alias("raw"), F.substring("digest", 1, 2).alias("bucket"))
    append_missing(materialise(scored, "scored"), path, ["digest"], "bucket")
    every = spark.read.schema(SCORES).parquet(path).select(F.col("digest").alias("__digest"), F.col("raw").alias("__raw"))
    joined = spread_join(keyed, every, ["__digest"], "left", by, salts)
    return with_class_scores(joined, "__raw").drop("__raw", "__digest")


def with_class_scores(df: DataFrame, raw: str) -> DataFrame:
    """Class scores (array of three) -> softmax shares, three-class compound and label."""
    shares = df.withColumn("__p", softmax(F.col(raw)))
    neg, neu, pos = (F.col("__p")[i] for i in range(3))
    return (shares.withColumns({
        "neg": neg, "neu": neu, "positive": pos,
        "compound": class_compound(neg, neu, pos), "label": label(polarity(pos, neg))}).drop("__p"))
