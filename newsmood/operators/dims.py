"""Country, subject and alias dimensions: small tables, joined like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.constants import ALIASES, SUBJECTS, TRACKED_COUNTRIES, WORLD


def _column(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def country_dim(spark: SparkSession, countries: list[str] = TRACKED_COUNTRIES) -> DataFrame:
    return _column(spark, "country", countries)


def subject_dim(spark: SparkSession, subjects: list[str] = SUBJECTS) -> DataFrame:
    return _column(spark, "subject", subjects)


def alias_dim(spark: SparkSession, aliases: dict[str, str] = ALIASES) -> DataFrame:
    return spark.createDataFrame(list(aliases.items()), "name string, alias string")


def with_code(df: DataFrame, codes: DataFrame, name: str, code: str = "country_code",
              unknown: str = "pass") -> DataFrame:
    """Adds the code of a country name. Unknown names pass through, or stop the job (``unknown='error'``).

    ``codes(name, code)`` has one row per name; Spark broadcasts it on its size, so the large side stays in place.
    """
    if unknown not in ("pass", "error"):
        raise ValueError(f"unknown: {unknown}")
    lookup = codes.select(F.col("name").alias(name), F.col("code").alias("__code"))
    fallback = F.col(name) if unknown == "pass" else F.raise_error(
        F.concat(F.lit("no code for country: "), F.coalesce(F.col(name), F.lit("NULL")))).cast("string")
    return (df.join(lookup, name, "left")
            .withColumn(code, F.coalesce(F.col("__code"), fallback)).drop("__code"))


def first_names(codes: DataFrame) -> DataFrame:
    """One name per code: the first in name order where a code has several."""
    return codes.groupBy("code").agg(F.min("name").alias("name"))


def with_name(df: DataFrame, codes: DataFrame, code: str, name: str = "country") -> DataFrame:
    """Adds the country name of a code; ``World`` where the code is unknown."""
    lookup = first_names(codes).select(F.col("code").alias(code), F.col("name").alias("__name"))
    return (df.join(lookup, code, "left")
            .withColumn(name, F.coalesce(F.col("__name"), F.lit(WORLD))).drop("__name"))


def with_alias(df: DataFrame, aliases: dict[str, str], name: str) -> DataFrame:
    """Replaces names that have an alias. The map is a constant of the query, so no join is needed."""
    if not aliases:
        return df
    pairs = [F.lit(v) for pair in aliases.items() for v in pair]
    return df.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name)), F.col(name)))


def work_grid(slots: DataFrame, countries: list[str], subjects: list[str] | None = None) -> DataFrame:
    """Every (slot, country[, subject]) to be loaded."""
    grid = work_grid_from(slots, _column(slots.sparkSession, "country", countries))
    return grid if subjects is None else grid.join(_column(slots.sparkSession, "subject", subjects))


def work_grid_from(slots: DataFrame, countries: DataFrame, name: str = "country") -> DataFrame:
    """``work_grid`` for a country table. The grid is the product of two dimensions, which is what is asked for."""
    return slots.join(countries.select(F.col(name).alias("target_country")).distinct())


def registered_codes(df: DataFrame, code: str = "country_code") -> DataFrame:
    return df.agg(F.count(code).alias("codes"))
