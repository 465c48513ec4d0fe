"""Translation at volume: each different title once, in batches of bounded size, remembered in a table.

A language may own most titles. Running sums over it are put together from buckets, the leading digits of the titles'
digests: sums within a bucket, and an offset for each of the at most 4,096 buckets of a language. So no language meets
in one task, and a batch is small whatever the language's size.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmood.functions.text import is_english, translator_language
from newsmood.operators.skew import spread_join
from newsmood.sources.shared import materialise
from newsmood.sources.writers import append_missing

MEMORY = "language string, digest string, title_en string, bucket string"
BATCH_TITLES, BATCH_CHARS = 150, 66_000
BUCKET = 3  # hexadecimal digits


def different_titles(articles: DataFrame, language: str = "language", title: str = "title",
                     english: str = "English") -> DataFrame:
    """(language, digest, title, chars): each title that is not English once per language, however many articles have it;
    null titles are left out."""
    foreign = articles.where(~is_english(F.col(language), english) & F.col(title).isNotNull())
    return (foreign.select(F.col(language).alias("language"), F.sha2(F.col(title), 256).alias("digest"),
                           F.col(title).alias("title"))
            .groupBy("language", "digest").agg(F.min("title").alias("title"))
            .withColumn("chars", F.length("title").cast("bigint")))


def batches(titles: DataFrame, most: int = BATCH_TITLES, budget: int = BATCH_CHARS) -> DataFrame:
    """``titles`` with their ``batch`` within the language: at most ``most`` titles and ``budget`` characters.

    Titles of more than half the budget are batches of their own. Others are cut, in the order of their digests, where
    the number of titles passes a multiple of ``most`` and where the characters pass one of half the budget: what a title
    adds beyond that is again half a budget at most.
    """
    half = budget // 2
    short = materialise(titles.where(F.col("chars") <= half).withColumn("bucket", F.substring("digest", 1, BUCKET)), "short")
    cell = ["language", "bucket"]
    before = Window.partitionBy("language").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (short.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"))
               .select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
                       F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c_before")))
    within = Window.partitionBy(*cell).orderBy("digest")
    chars = F.coalesce(F.sum("chars").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (short.withColumn("n_in", F.row_number().over(within) - 1).withColumn("c_in", chars).join(offsets, cell)
              .withColumn("batch", F.concat_ws(
                  "-", F.expr(f"(n_before + n_in) div {most}"), F.expr(f"(c_before + c_in) div {half}"))))
    names = ["language", "digest", "title", "chars", "batch"]
    long = titles.where(F.col("chars") > half).withColumn("batch", F.concat(F.lit("long-"), F.col("digest")))
    return placed.select(*names).unionByName(long.select(*names))


def translated(batched: DataFrame, translator: Callable[[str, list[str]], list]) -> DataFrame:
    """(language, digest, title_en): one call of ``translator(language, titles)`` for each batch; what it answers with no
    text is left out. The language is spelled as the translator has it."""
    def call(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("digest")
        done = pd.Series(translator(rows["spelled"].iloc[0], rows["title"].tolist()), index=rows.index, dtype=object)
        return rows[["language", "digest"]].assign(title_en=done)[done.map(lambda t: isinstance(t, str))]

    return (batched.withColumn("spelled", translator_language(F.col("language"))).groupBy("language", "batch")
            .applyInPandas(call, "language string, digest string, title_en string"))


def remember(articles: DataFrame, path: str, translator: Callable[[str, list[str]], list], language: str = "language",
             title: str = "title", english: str = "English", most: int = BATCH_TITLES,
             budget: int = BATCH_CHARS) -> DataFrame:
    """Translates the titles that the memory table under ``path`` does not hold, adds them, and returns the whole memory.

    Failures are not remembered, so the next run tries them again.
    """
    spark = articles.sparkSession
    spark.createDataFrame([], MEMORY).write.mode("append").partitionBy("bucket").parquet(path)  # the table is there
    memory = spark.read.schema(MEMORY).parquet(path)
    pending = different_titles(articles, language, title, english).join(
        memory.select("language", "digest"), ["language", "digest"], "left_anti")
    done = translated(batches(materialise(pending, "pending"), most, budget), translator)
    append_missing(materialise(done.withColumn("bucket", F.substring("digest", 1, 1)), "translated"), path,
                   ["language", "digest"], "bucket")
    return spark.read.schema(MEMORY).parquet(path)


def from_memory(articles: DataFrame, memory: DataFrame, language: str = "language", title: str = "title",
                english: str = "English", by: list[str] | None = None, salts: int = 8) -> DataFrame:
    """English titles as they are, others as remembered; articles without a translation are dropped. ``by`` tells copies
    of a title apart, which then are spread over tasks."""
    lookup = memory.select(F.col("language").alias(language), F.col("digest").alias("__digest"), "title_en")
    joined = spread_join(articles.withColumn("__digest", F.sha2(F.col(title), 256)), lookup, [language, "__digest"],
                         "left", by or [], salts if by else 1)
    native = is_english(F.col(language), english)
    return (joined.where(native | F.col("title_en").isNotNull())
            .withColumn(title, F.when(native, F.col(title)).otherwise(F.col("title_en"))).drop("title_en", "__digest"))
