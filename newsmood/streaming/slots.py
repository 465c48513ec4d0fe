"""The recurring load as Structured Streaming: slot counts, deduplication, idempotent append, backfill.

``start_closed_counts`` is the form for a load that never ends. Rows later than the watermark are left out by Spark and
counted: ``late_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from newsmood.constants import SLOT_HOURS
from newsmood.functions.sentiment import tally
from newsmood.functions.timing import from_instant, slot_start, to_instant
from newsmood.sources.writers import append_missing


def read_stream(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Stream over the parquet files that land in a folder."""
    reader = spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_watermark(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Adds ``instant``, the zoned form of an NTZ time that a watermark needs, read as UTC."""
    return df.withColumn("instant", to_instant(F.col(time))).withWatermark("instant", delay)


def slot_counts(df: DataFrame, keys: list[str], label: str = "label", hours: int = SLOT_HOURS) -> DataFrame:
    """Label counts per tumbling slot and keys; the same plan on a stream and on a table."""
    window = F.window("instant", f"{hours} hours")
    return (df.groupBy(window.alias("w"), *keys).agg(*tally(F.col(label)))
            .select(from_instant(F.col("w.start")).alias("slot"), *keys, "negative", "neutral", "positive"))


def dedup_stream(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drops titles seen before within the watermark, over batch borders."""
    return df.dropDuplicatesWithinWatermark(keys)


def start_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the complete counts in ``path``, for totals over all slots: batches write to two folders in turn and readers
    take the newer (``latest``), so there is always a whole version and never more than two."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/v={batch_id % 2}")

    return (counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def start_closed_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each slot's counts once, when the watermark has passed it, to a day-partitioned table.

    State and output stay as small as the open slots.
    """
    return (counts.withColumn("day", F.to_date("slot")).writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .partitionBy("day").format("parquet").start(path))


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newer of the two versions of streamed counts."""
    versions = spark.read.schema(StructType(schema.fields).add("batch", IntegerType()).add("v", IntegerType())).parquet(path)
    newest = versions.agg(F.max("batch").alias("batch")).scalar()
    return versions.where(F.col("batch") == newest).drop("batch", "v")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the batches the query reports on."""
    return sum(state.numRowsDroppedByWatermark for p in query.recentProgress for state in p.stateOperators)


def start_append(df: DataFrame, path: str, checkpoint: str, keys: list[str], partition: str = "day") -> StreamingQuery:
    """Appends each batch to the stored table, leaving out rows that are there already by ``keys``.

    ``keys`` identify a row, such as (country, slot, scope, title, model): a slot may come in any number of batches.
    A batch that was written before a failure and is run again adds nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        append_missing(batch, path, keys, partition)

    return (df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def backfill(df: DataFrame, slots: DataFrame, time: str, hours: int = SLOT_HOURS) -> DataFrame:
    """The rows of many slots at once, with the start of theirs in ``slot``: one pass, however many slots there are.

    ``slots`` has the starts in its column ``slot``.
    """
    wanted = slots.select("slot").distinct()
    return df.withColumn("slot", slot_start(F.col(time), hours)).join(wanted, "slot", "left_semi")
