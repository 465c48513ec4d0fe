"""The counts rollup kept up to date by signed partial counts, instead of being computed again from the fact.

A batch adds headlines, withdraws headlines, or replaces them (the old rows withdrawn, the new ones added). Its counts per
key and day are merged into the stored rollup; only the days it touches are read and written. Every day carries the number
of the last batch merged into it, written with its rows: a batch that is run again after a failure changes nothing in the
days it has reached. Batches are numbered in the order they are merged in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.constants import LABELS
from newsmood.operators.labels import tally_labels
from newsmood.sources.shared import materialise
from newsmood.sources.writers import touched

KEYS = ["target_country", "slot", "scope", "model"]


def delta(added: DataFrame | None = None, withdrawn: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Signed label counts per key and day of fact rows that come and go; keys whose counts do not change are left out."""
    parts = []
    for sign, rows in ((1, added), (-1, withdrawn)):
        if rows is not None:
            parts.append(tally_labels(rows, [*keys, "day"])
                         .select(*keys, "day", *[(F.col(c) * sign).alias(c) for c in LABELS]))
    if not parts:
        raise ValueError("give rows that are added, withdrawn or both")
    return _summed(reduce(DataFrame.unionByName, parts), keys).where(" OR ".join(f"{c} <> 0" for c in LABELS))


def _summed(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys, "day").agg(*[F.sum(c).alias(c) for c in LABELS])


def _schema(change: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in change.schema.fields) + ", batch bigint"


def merge(change: DataFrame, path: str, batch: int, keys: list[str] = KEYS) -> None:
    """Merges the signed counts of batch number ``batch`` into the rollup under ``path``.

    Keys whose counts come to nothing stay with zeros, so that the partition of a day which loses all headlines is
    written too.
    """
    spark = change.sparkSession
    change = materialise(change, "delta")
    change.withColumn("batch", F.lit(batch)).limit(0).write.mode("append").partitionBy("day").parquet(path)
    table = spark.read.schema(_schema(change)).parquet(path)
    stored = touched(change, table, "day")
    merged_to = stored.groupBy(F.col("day").alias("known_day")).agg(F.max("batch").alias("upto"))
    fresh = (change.join(merged_to, F.col("day").eqNullSafe(F.col("known_day")), "left")
             .where(F.coalesce("upto", F.lit(-1)) < batch).drop("known_day", "upto"))
    days = materialise(fresh.select(F.col("day").alias("fresh_day")).distinct(), "days")
    kept = stored.join(days, F.col("day").eqNullSafe(F.col("fresh_day")), "left_semi").drop("batch")
    rows = materialise(_summed(kept.unionByName(fresh), keys).withColumn("batch", F.lit(batch).cast("bigint")), "merged")
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def read(spark: SparkSession, path: str, change_schema: DataFrame) -> DataFrame:
    """The rollup: its keys and counts, without those that have come to nothing."""
    rows = spark.read.schema(_schema(change_schema)).parquet(path)
    return rows.where(" OR ".join(f"{c} <> 0" for c in LABELS)).drop("batch")
