"""Row types and table schemas.

The working layout is the long fact ``SCORED_HEADLINE`` plus the rollup ``SENTIMENT_COUNTS``; the two nested tables
are derived from them (``operators.nested``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DateType, DoubleType, FloatType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D, _F = StringType(), IntegerType(), LongType(), DoubleType(), FloatType()

SENTIMENT = _struct(neg=_F, neu=_F, pos=_F, compound=_F)
HEADLINE_DAILY = _struct(title=_S, domain=_S)
HEADLINE = _struct(title=_S, domain=_S, source_country=_S)
COUNT_SENTIMENT = _struct(negative=_L, neutral=_L, positive=_L)
COUNTRY_MENTION = _struct(country_code=_S, count=_L)

ARTICLE = _struct(url=_S, url_mobile=_S, title=_S, seendate=_S, socialimage=_S, domain=_S, language=_S,
                  sourcecountry=_S)
ARTICLE_PAYLOAD = _struct(articles=ArrayType(ARTICLE))
MENTION_COUNT = _struct(domain=_S, countrycode=_S, cnt=_L)
RANK = _struct(rank=_D, domain=_S)
OUTLET = _struct(domain=_S, facebook_fol=_S, twitter_fol=_S, insta_fol=_S, freq_post=_S, domain_auth=_S)
COUNTRY_CODE = _struct(name=_S, code=_S)
STAGED = _struct(query=_S, titles=ArrayType(ArrayType(_S)))
SCORED_PAYLOAD = _struct(
    sentiment_arr_nat=ArrayType(_S), titles_nat=ArrayType(ArrayType(_S)),
    sentiment_arr_inter=ArrayType(_S), titles_inter=ArrayType(ArrayType(_S)),
    target_country=_S, short_subject=_S, on_day=_D)
SCORED_PAYLOAD.add("is_hourly", "boolean")

SCORED_HEADLINE = _struct(
    target_country=_S, slot=TimestampNTZType(), scope=_S, pos=_L, title=_S, domain=_S, source_country=_S,
    subjects=ArrayType(_S), model=_S, neg=_D, neu=_D, positive=_D, compound=_D, day=DateType())
SENTIMENT_COUNTS = _struct(
    target_country=_S, slot=TimestampNTZType(), scope=_S, model=_S, negative=_L, neutral=_L, positive=_L,
    day=DateType())
DOMAIN_INFO = _struct(
    domain=_S, country_code=_S, country_mentions=ArrayType(COUNTRY_MENTION), domain_weight=_F, change_date=_S,
    domain_auth=_I)


def _nested(time_name, time_type, headline, subject):
    fields = [("target_country", _S), (time_name, time_type)]
    if subject:
        fields.append(("on_subject", _S))
    fields += [
        ("headline_national", ArrayType(headline)), ("headline_inter", ArrayType(headline)),
        ("sentiment_national", ArrayType(ArrayType(SENTIMENT))),
        ("sentiment_inter", ArrayType(ArrayType(SENTIMENT))),
        ("senti_count_nat", ArrayType(COUNT_SENTIMENT)), ("senti_count_int", ArrayType(COUNT_SENTIMENT)),
        ("latest_processed", time_type), ("part", _I), ("first_pos", _L),
    ]
    return StructType([StructField(name, kind) for name, kind in fields])


GLOBAL_INFO = _nested("on_day", DateType(), HEADLINE_DAILY, subject=True)
GLOBAL_INFO_SLOT = _nested("on_time", TimestampNTZType(), HEADLINE, subject=False)

# name -> (schema, partition columns)
TABLES = {
    "scored_headline": (SCORED_HEADLINE, ["day"]),
    "sentiment_counts": (SENTIMENT_COUNTS, ["day"]),
    "global_info": (GLOBAL_INFO, ["on_day"]),
    "global_info_hourly": (StructType(GLOBAL_INFO_SLOT.fields + [StructField("day", DateType())]), ["day"]),
    "domain_info": (DOMAIN_INFO, []),
}


def create_tables(spark: SparkSession, names=None) -> None:
    """``CREATE TABLE IF NOT EXISTS`` for the declared tables, date-partitioned parquet."""
    for name in names or TABLES:
        schema, partitions = TABLES[name]
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{by}")


def as_table(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; a missing column is NULL."""
    return df.select([_cast(df, field) for field in schema.fields])


def _cast(df: DataFrame, field: StructField) -> Column:
    column = F.col(field.name) if field.name in df.columns else F.lit(None)
    return column.cast(field.dataType).alias(field.name)


def checked_label(label: Column, allowed: list[str]) -> Column:
    """The enum check: an unknown non-NULL value stops the job."""
    bad = label.isNotNull() & ~label.isin(*allowed)
    return F.when(bad, F.raise_error(F.concat(F.lit("not a label: "), label)).cast("string")).otherwise(label)
