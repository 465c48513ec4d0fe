"""The load as a stream: articles as they land -> titles of closed slots -> scored headlines.

One stateful step holds, for every (country, scope, slot, title), the article seen first until the watermark has passed
the end of the slot, and the text of a title with the first of its countries only; then the slot's titles leave the state together and are never seen again. So a micro-batch holds
closed slots whole, and what is decided for a slot as a whole - whether a group has a relevant article, whether both
scopes are there, the position of a title - is decided by the same operators as in the batch load, on its rows alone.
Rows later than the watermark are left out by Spark and counted (``slots.late_rows``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsmood import schemas
from newsmood.constants import SLOT_HOURS, SUBJECTS
from newsmood.functions.timing import from_instant
from newsmood.operators.articles import scope_pairs, text_digest
from newsmood.plans import ingest
from newsmood.sources.readers import article_rows
from newsmood.sources.shared import materialise
from newsmood.sources.writers import only_new, touched
from newsmood.streaming.slots import with_watermark

CARRIED = ["title", "domain", "language", "source_country", "subjects"]
HEADLINE = ["target_country", "slot", "scope", "digest", "model"]


def read_articles(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Article payloads that land in a folder, as a stream of articles."""
    reader = spark.readStream.schema(schemas.ARTICLE_PAYLOAD).option("mode", "DROPMALFORMED")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return article_rows(reader.json(path))


def closed_titles(articles: DataFrame, country_terms: dict[str, str], delay: str, subjects: list[str] | None = SUBJECTS,
                  hours: int = SLOT_HOURS) -> DataFrame:
    """The different titles of each (country, scope, slot) once the slot is closed: of equal ones that seen first, then
    that of the smaller url. As in ``ingest.first_articles``, titles are known by ``digest`` and stand beside the first of
    their countries. A slot leaves the state whole, so the text comes with the other countries' rows."""
    known = articles.withColumn("digest", text_digest(F.col("title")))
    pairs = with_watermark(scope_pairs(known, country_terms, subjects, by=["url"], once=True), "seen", delay)
    first = F.min(F.struct("seen", "url", *CARRIED)).alias("a")
    found = pairs.groupBy(F.window("instant", f"{hours} hours").alias("w"), "target_country", "scope",
                          "digest").agg(first)
    return found.select("target_country", "scope", from_instant(F.col("w.start")).alias("slot"), "digest", "a.seen", "a.url",
                        *[f"a.{c}" for c in CARRIED])


def start_load(titles: DataFrame, path: str, checkpoint: str, codes: DataFrame, relevant: DataFrame,
               lexicon: DataFrame | None = None, make_scorer: Callable | None = None,
               translations: DataFrame | None = None, english: str = "English") -> StreamingQuery:
    """Scores the titles of closed slots and appends them to the day-partitioned fact under ``path``.

    A micro-batch that is run again after a failure adds nothing: its rows are known by (country, slot, scope, title,
    model).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        unique = materialise(batch, "closed")
        if unique.isEmpty():
            return
        ranked, texts = ingest.place_titles(unique, codes, relevant, translations, english=english)
        scored = ingest.score_titles(ranked, texts, lexicon, make_scorer)
        empty = ingest.with_texts(scored, texts).limit(0)  # the table is there, also for the first batch
        empty.write.mode("append").partitionBy("day").parquet(path)
        stored = touched(ranked.withColumn("day", F.to_date("slot")), batch.sparkSession.read.schema(empty.schema).parquet(path), "day")
        # What is stored is compared by digest too, so no title is shuffled for it.
        new = only_new(scored, stored.withColumn("digest", text_digest(F.col("title"))), HEADLINE)
        ingest.with_texts(new, texts).write.mode("append").partitionBy("day").parquet(path)

    return (titles.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())
