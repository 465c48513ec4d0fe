"""Readers. Schemas are given, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsmood import schemas
from newsmood.functions.text import file_country_code
from newsmood.sources.shared import materialise

JSON_TIMES = "yyyyMMdd'T'HHmmss'Z'"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Landed article payloads, one JSON object per line -> one row per article.

    Empty and unreadable payloads give no rows. ``arrival`` is the position within the payload, ``seen`` the parsed
    time (NULL if unreadable).
    """
    return article_rows(spark.read.schema(schemas.ARTICLE_PAYLOAD).option("mode", "DROPMALFORMED").json(path))


def article_rows(payloads: DataFrame) -> DataFrame:
    """The articles of payloads, of a table or a stream."""
    rows = payloads.select(F.posexplode("articles").alias("arrival", "a")).select("arrival", "a.*")
    return rows.withColumns({
        "seen": F.try_to_timestamp("seendate", F.lit(JSON_TIMES)).cast("timestamp_ntz"),
        "source_country": F.col("sourcecountry")}).drop("sourcecountry")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Article payloads as ``articles``, and in ``broken`` the line of one that cannot be read, where there is one."""
    schema = StructType([*schemas.ARTICLE_PAYLOAD.fields, StructField("broken", StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of {domain, countrycode, cnt} -> (domain, code, cnt)."""
    rows = spark.read.schema(schemas.MENTION_COUNT).option("multiLine", True).json(path)
    return rows.select("domain", F.col("countrycode").alias("code"), "cnt")


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files that hold one JSON array of objects each, split over tasks like any text, however large the array is.

    A file is cut at every closing brace. Whether a brace stands in a string follows from the parity of the quotes before
    it, and whether it ends an object of the array from the depth of the braces outside strings; both are carried over
    the splits of a file as sums of the splits before. Pieces of one object are put together again and parsed.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    stored = materialise(pieces, "pieces")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    marked = _carried(stored.withColumn("quotes", quotes), "quotes")
    inside = F.col("quotes_before") % 2 == 1
    outer = F.regexp_replace(F.when(inside, F.regexp_replace(plain, r'(?s)^[^"]*("|$)', "")).otherwise(plain),
                             r'(?s)"[^"]*("|$)', "")
    real = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    opened = F.length(outer) - F.length(F.replace(outer, F.lit("{"), F.lit("")))
    marked = _carried(marked.withColumn("real", real).withColumn("depth", opened - F.when(real, 1).otherwise(0)), "depth")
    ends = F.when(F.col("real") & (F.col("depth_before") + F.col("depth") == 0), 1).otherwise(0)
    marked = _carried(marked.withColumn("ends", ends), "ends")
    objects = marked.groupBy("file", F.col("ends_before").alias("number")).agg(
        F.concat_ws("}", F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"])).alias("v"))
    text = F.ltrim(F.col("v"), F.lit("[, \t\r\n"))
    return (objects.where(text.startswith("{")).select(F.from_json(F.concat(text, F.lit("}")), schema).alias("o"))
            .select("o.*"))


def read_marked(spark: SparkSession, path: str, mark: str, nested: bool = False) -> DataFrame:
    """(file, number, value): what stands between the marks of each file, numbered from 0. The mark is the reader's line
    separator, so a file is split over tasks, however large it is; the numbers are carried over its splits. ``nested`` reads
    the folders within the path as well."""
    pieces = spark.read.option("lineSep", mark).option("recursiveFileLookup", nested).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    return _carried(materialise(pieces, "pieces").withColumn("one", F.lit(1)), "one").select(
        "file", F.col("one_before").alias("number"), "value")


def _carried(pieces: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_before``: its sum over the pieces before in the file, within the split and over those before it."""
    split = ["file", "block"]
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.groupBy(*split).agg(F.sum(column).alias("n"))
               .select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(column).over(within), F.lit(0))
    return materialise(pieces.withColumn("own", own).join(offsets, split)
                       .withColumn(f"{column}_before", F.col("own") + F.col("offset")).drop("own", "offset"), "carried")


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """The scored headlines stored under a path."""
    return spark.read.schema(schemas.SCORED_HEADLINE).parquet(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Folder of per-country rank files -> (domain, code, rank). Further columns of a file are ignored."""
    rows = (spark.read.schema(schemas.RANK).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path))
    return rows.select(F.trim("domain").alias("domain"),
                       file_country_code(F.col("_metadata.file_name")).alias("code"), "rank")


def read_authority(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OUTLET).option("multiLine", True).json(path)


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("lang string").option("header", True).csv(path)


def read_country_codes(spark: SparkSession, path: str) -> DataFrame:
    """(name, code) from a CSV with header. A name given twice keeps the code of its last line."""
    rows = spark.read.schema(schemas.COUNTRY_CODE).option("header", True).csv(path)
    line = rows.withColumn("line", F.monotonically_increasing_id())
    return line.groupBy("name").agg(F.max_by("code", "line").alias("code"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (token, valence, ...) file."""
    rows = spark.read.schema("token string, valence double").option("sep", "\t").option("quote", "").csv(path)
    return rows.where(F.col("token").isNotNull() & F.col("valence").isNotNull())


def read_pages(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Scraped pages, one file each, as (path, text); a page stored as a JSON string is unquoted. ``nested`` reads the
    folders within the path as well: names of the form key=value are then no columns that the driver has to collect."""
    pages = spark.read.text(path, wholetext=True, recursiveFileLookup=nested)
    plain = F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v string")["v"]
    text = F.when(F.trim("value").startswith('"'), F.coalesce(plain, F.col("value"))).otherwise(F.col("value"))
    return pages.select(F.col("_metadata.file_path").alias("path"), text.alias("text"))


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 driver: str = "org.postgresql.Driver", column: str | None = None, lower=None, upper=None,
                 partitions: int | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a JDBC scan. A partition column needs its bounds and a partition count, and all or none is given:
    without them one task would read the whole table."""
    split = [column, lower, upper, partitions]
    if any(v is not None for v in split) and any(v is None for v in split):
        raise ValueError("column, lower, upper and partitions go together")
    options = {"url": url, "dbtable": table, "driver": driver, "fetchsize": fetch_size, "user": user,
               "password": password, "partitionColumn": column, "lowerBound": lower, "upperBound": upper,
               "numPartitions": partitions}
    return {k: str(v) for k, v in options.items() if v is not None}


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def read_table(spark: SparkSession, table: str, where: Column | None = None) -> DataFrame:
    rows = spark.table(table)
    return rows if where is None else rows.where(where)


def read_staged(spark: SparkSession, path: str, country: str | None = None, slot_key: str | None = None) -> DataFrame:
    """Staged titles, all or those of one country and slot, for which an empty result is an error, as a missing file is."""
    rows = spark.read.schema("query string, titles array<array<string>>, target_country string, slot_key string") \
        .json(path)
    if country is None:
        return rows
    rows = rows.where((F.col("target_country") == country) & (F.col("slot_key") == slot_key))
    if rows.isEmpty():
        raise FileNotFoundError(f"nothing staged for {country} at {slot_key}")
    return rows


def staged_titles(staged: DataFrame) -> DataFrame:
    """Staged payloads -> (target_country, slot_key, query, pos, title, domain, source_country)."""
    return (staged.select("target_country", "slot_key", "query", F.posexplode("titles").alias("pos", "t"))
            .select("target_country", "slot_key", "query", "pos", F.get("t", F.lit(0)).alias("title"),
                    F.get("t", F.lit(1)).alias("domain"), F.get("t", F.lit(2)).alias("source_country")))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored payloads; the mixed score arrays are parsed per model."""
    raw = spark.read.schema(schemas.SCORED_PAYLOAD).json(path)
    lexicon = "array<struct<neg:double,neu:double,pos:double,compound:double>>"

    def parsed(column: str) -> list[Column]:
        return [F.from_json(F.get(column, F.lit(0)), lexicon).alias(f"lexicon_{column[14:]}"),
                F.from_json(F.get(column, F.lit(1)), "array<array<double>>").alias(f"classes_{column[14:]}")]

    return raw.select(
        "target_country", "short_subject", "is_hourly",
        F.timestamp_add("SECOND", F.col("on_day").cast("bigint"), F.lit("1970-01-01").cast("timestamp_ntz"))
        .alias("on_time"),
        "titles_nat", "titles_inter", *parsed("sentiment_arr_nat"), *parsed("sentiment_arr_inter"))


def import_batch(spark: SparkSession, root: str, day: str) -> DataFrame:
    """One day's batch; only that day's folder is read."""
    return spark.read.parquet(root).where(F.col("batch_day") == F.lit(day).cast("date"))


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    where = f" IN {database}" if database else ""
    return spark.sql(f"SHOW TABLES{where}").where(~F.col("isTemporary"))
