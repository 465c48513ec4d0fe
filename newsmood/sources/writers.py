"""Writers. Tables are date-partitioned parquet; files are sized by Spark's rebalance, so a day that holds most of
the rows is split over tasks instead of being written by one."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood import schemas
from newsmood.functions.text import safe_name
from newsmood.functions.timing import epoch_seconds, second_key
from newsmood.operators.skew import SALT, SALTS, salt


def append(df: DataFrame, table: str, columns: list[str] | None = None) -> None:
    """Appends to an existing table, columns by name; those not given are NULL."""
    target = df.sparkSession.table(table).schema
    given = df.select(*columns) if columns else df
    unknown = set(given.columns) - set(target.names)
    if unknown:
        raise ValueError(f"{table} has no column {sorted(unknown)}")
    schemas.as_table(given, target).write.insertInto(table)


def only_new(df: DataFrame, stored: DataFrame, keys: list[str], by: list[str] | None = None,
             salts: int = SALTS) -> DataFrame:
    """Rows whose key is not stored yet, each once. ``keys`` identify a row, so none of them is hot; where they do not,
    ``by`` are the columns that tell rows of one key apart, and all rows of a new key stay. A null in a key is a value
    like any other: rows with nulls are found again too."""
    known = stored.select(*[F.col(k).alias(f"__known_{k}") for k in keys]).distinct()
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__known_{k}")) for k in keys))
    if by is None:
        return df.dropDuplicates(keys).join(known, same, "left_anti")
    spread = known.withColumn("__known_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (df.withColumn(SALT, salt(by, salts))
            .join(spread, same & (F.col(SALT) == F.col("__known_salt")), "left_anti").drop(SALT))


def touched(df: DataFrame, stored: DataFrame, partition: str) -> DataFrame:
    """The stored rows of the partitions that ``df`` has rows in, the null one included: a batch touches few days, and
    only they are read."""
    values = [r[0] for r in df.select(partition).distinct().collect()]
    wanted = F.col(partition).isin([v for v in values if v is not None])
    return stored.where(wanted | F.col(partition).isNull() if None in values else wanted)


def append_new(df: DataFrame, table: str, keys: list[str], partition: str = "day") -> None:
    """Appends the rows that are not in the table yet by ``keys``, which identify a row; running it again adds nothing.

    A headline is identified by (country, slot, scope, title, model); (country, slot) alone would leave out every
    headline of a slot but those that came first.
    """
    append(only_new(df, touched(df, df.sparkSession.table(table), partition), keys), table)


def append_missing(batch: DataFrame, path: str, keys: list[str], partition: str = "day") -> None:
    """Appends the rows of a batch that the table does not hold by ``keys``; reads only the partitions it touches."""
    spark = batch.sparkSession
    # A table of this shape without rows is written first, so that the first batch can be compared with it too.
    batch.limit(0).write.mode("append").partitionBy(partition).parquet(path)
    stored = touched(batch, spark.read.schema(batch.schema).parquet(path), partition)
    only_new(batch, stored, keys).write.mode("append").partitionBy(partition).parquet(path)


RANK_FILE = "domains-by-country-"  # with the number of a file behind the country's code


def write_ranks(ranks: DataFrame, path: str) -> None:
    """(domain, code, rank) as CSV files of (rank, domain), which carry the country's code in their name.

    Spark names the files it writes; they are renamed on the storage by the driver, which sees no rows: a name for each
    file, of which a country has as many as its rows fill.
    """
    spark, staged = ranks.sparkSession, f"{path}/_staged"
    ranks.select("code", "rank", "domain").write.partitionBy("code").csv(staged)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n, file in enumerate(fs.globStatus(hadoop.Path(f"{staged}/code=*/part-*"))):
        code = file.getPath().getParent().getName().partition("=")[2]
        fs.rename(file.getPath(), hadoop.Path(f"{path}/{RANK_FILE}{code}-{n}.csv"))
    fs.delete(hadoop.Path(staged), True)


def save_clustered(df: DataFrame, table: str, by: list[str], buckets: int, path: str | None = None) -> None:
    """Stores a table in ``buckets`` buckets by ``by``, sorted by it: joins and aggregates on these columns need no
    exchange of the table, and row groups hold few values of the first column, so an equality on it skips the others.

    Rows are brought together by bucket first, so that a task does not write a file for every bucket it meets. With a
    ``path`` the table is kept there instead of in the warehouse.
    """
    writer = df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).mode("overwrite").format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def write_partitioned(df: DataFrame, path: str, partition: str = "day", mode: str = "append") -> None:
    df.hint("rebalance", F.col(partition)).write.mode(mode).partitionBy(partition).parquet(path)


def stage(titles: DataFrame, path: str, query: Column, chunk: int = 1_000) -> None:
    """Titles(target_country, slot, pos, title, domain, source_country) as payloads per country and slot.

    A payload holds at most ``chunk`` titles, so that no group has to fit into one row; a larger group is several
    payloads of the same folder.
    """
    part = F.floor(F.col("pos") / chunk)
    item = F.struct("pos", F.array("title", "domain", "source_country").alias("t"))
    payloads = (titles.groupBy("target_country", second_key(F.col("slot")).alias("slot_key"), part.alias("part"))
                .agg(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["t"]).alias("titles")))
    (payloads.select(query.alias("query"), "titles", "target_country", "slot_key")
     .write.mode("append").partitionBy("target_country", "slot_key").json(path))


def write_scored(nested: DataFrame, path: str, short_subject: str = "Any Subject", hourly: bool = True) -> None:
    """Nested rows as scored payloads, one JSON object per (country, slot, part)."""
    def titles(column: str) -> Column:
        return F.transform(F.col(column), lambda h: F.array(h["title"], h["domain"], h["source_country"]))

    def scores(column: str) -> Column:
        models = F.col(column)
        classes = F.transform(F.get(models, F.lit(1)), lambda s: F.array(s["neg"], s["neu"], s["pos"]))
        return F.array(F.to_json(F.get(models, F.lit(0))), F.to_json(classes), F.lit(None).cast("string"))

    nested.select(
        scores("sentiment_national").alias("sentiment_arr_nat"), titles("headline_national").alias("titles_nat"),
        scores("sentiment_inter").alias("sentiment_arr_inter"), titles("headline_inter").alias("titles_inter"),
        "target_country", F.lit(short_subject).alias("short_subject"),
        epoch_seconds(F.col("slot")).cast("double").alias("on_day"), F.lit(hourly).alias("is_hourly"),
    ).write.mode("append").option("ignoreNullFields", False).json(path)


def export_batch(df: DataFrame, root: str, day: str) -> None:
    """One day's batch under ``root/batch_day=...``; exporting a day again replaces that day only."""
    rows = df.withColumn("batch_day", F.lit(day).cast("date"))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_day").parquet(root))


def batch_name(prefix: str, day: Column) -> Column:
    """``<prefix>_batch_<day>`` with no colon in it."""
    return safe_name(F.concat(F.lit(prefix + "_batch_"), day.cast("string")))


def write_responses(responses: DataFrame, path: str) -> None:
    """Response rows as text, one JSON array per line."""
    responses.select("response").write.mode("overwrite").text(path)
