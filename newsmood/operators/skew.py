"""Joins, top-n and ranking that hold when one key owns a large share of the rows.

The salt is a hash of columns that tell rows of the hot key apart. It is never ``rand()``: a task that is run
again after a lost executor must send each row to the same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood.sources.shared import materialise

SALT = "__salt"
SALTS = 16


def salt(by: list[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")


def spread_join(big: DataFrame, small: DataFrame, on: list[str], how: str, by: list[str],
                salts: int = SALTS) -> DataFrame:
    """Equi join of a large side that may have hot keys with a much smaller side.

    Rows of the large side get a salt, each row of the small side is repeated once per salt, so a hot key is
    shared out over ``salts`` tasks and every large row still meets each partner exactly once. No broadcast hint:
    Spark broadcasts the small side when its size is known, at plan or at run time, to be below the threshold.
    ``how`` must keep to the large side: inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type: {how}")
    if salts <= 1:
        return big.join(small, on, how)
    spread = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn(SALT, salt(by, salts)).join(spread, [*on, SALT], how).drop(SALT)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group.

    ``row_number() = 1`` lets Spark keep one row per group and map task before the shuffle, so a group that
    holds a third of the rows reaches its task as at most one row per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, by: list[str],
                    salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each group in a total order, exactly.

    Two rounds: the first ``n`` within (group, salt), then the first ``n`` of those. Before each shuffle Spark
    keeps ``n`` rows per group and task, and the last round sees at most ``n * salts`` rows of any group.
    """
    rank = "__rank"
    inner = Window.partitionBy(*keys, SALT).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(SALT, salt(by, salts))
            .withColumn(rank, F.row_number().over(inner)).where(F.col(rank) <= n).drop(SALT, rank)
            .withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n).drop(rank))


def positions(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
              name: str = "pos") -> DataFrame:
    """0-based position of each row in its group, without bringing a group together.

    ``bucket`` must not decrease along ``order`` (such as ``id div 4096`` for an order by ``id``). Rows are ranked
    within (group, bucket); the offset of a bucket is the row count of the buckets before it.
    """
    marked = df.withColumn("__bucket", bucket)
    cell = [*keys, "__bucket"]
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (marked.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    return (marked.join(offsets, cell, "inner")
            .withColumn(name, F.col("__offset") + rank - F.lit(1))
            .drop("__bucket", "__offset"))


def positions_by_range(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """``positions`` for any order: the buckets are ranges of (keys, order), cut at quantiles that Spark samples.

    A group of any size is as many ranges as its rows fill, and the offset of a range is the count of those before it.
    The ranges are written once, so that the numbers do not depend on how often they are sampled. Rows that are equal in
    keys and order share a range.
    """
    ranged = df.repartitionByRange(*map(F.col, keys), *order).withColumn("__range", F.spark_partition_id())
    return positions(materialise(ranged, "ranges"), keys, order, F.col("__range"), name).drop("__range")
