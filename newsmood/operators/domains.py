"""The domain dimension: mention counts, best rank and authority per domain, and which domains matter where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.constants import MIN_MENTIONS, MIN_WEIGHT
from newsmood.functions.sentiment import domain_weight


def collect_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions(domain, code, cnt) -> one row per domain with its mentions by code.

    Counts are reduced to one per (domain, code) first, the largest, which is what every threshold looks at. The
    array is so bounded by the number of countries, whatever the input holds.
    """
    per_code = mentions.groupBy("domain", "code").agg(F.max("cnt").alias("count"))
    entry = F.struct(F.col("code").alias("country_code"), F.col("count").cast("bigint").alias("count"))
    return per_code.groupBy("domain").agg(F.sort_array(F.collect_list(entry)).alias("country_mentions"))


def best_rank(ranks: DataFrame) -> DataFrame:
    """Ranks(domain, code, rank) -> country and weight of the best rank; the lower code on a tie."""
    best = ranks.groupBy("domain").agg(F.min(F.struct("rank", "code")).alias("best"))
    return best.select("domain", F.col("best.code").alias("country_code"),
                       domain_weight(F.col("best.rank")).alias("domain_weight"))


def build_domain_info(mentions: DataFrame, ranks: DataFrame, authority: DataFrame | None = None,
                      change_date: Column | None = None) -> DataFrame:
    """Mentioned domains with best rank and authority where known; unranked domains weigh 0.

    All three sides are grouped by domain, so the joins reuse that partitioning.
    """
    info = (collect_mentions(mentions).join(best_rank(ranks), "domain", "left")
            .withColumn("domain_weight", F.coalesce(F.col("domain_weight"), F.lit(0.0))))
    if authority is None:
        info = info.withColumn("domain_auth", F.lit(None).cast("int"))
    else:
        per_domain = authority.groupBy("domain").agg(
            F.max(F.col("domain_auth").try_cast("int")).alias("domain_auth"))
        info = info.join(per_domain, "domain", "left")
    stamp = F.date_format(F.current_timestamp(), "yyyyMMddHHmmss") if change_date is None else change_date
    return info.select("domain", "country_code", "country_mentions", "domain_weight",
                       stamp.alias("change_date"), "domain_auth")


def unmatched_authority(mentions: DataFrame, authority: DataFrame) -> DataFrame:
    """Authority rows whose domain is not mentioned anywhere."""
    return authority.join(mentions.select("domain").distinct(), "domain", "left_anti")


def unique_domains(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["domain"])


def with_mention(mentions: Column, min_count: int | None = None, code: str | None = None) -> Column:
    """Some mention is above the count and, if given, of the country."""
    def test(m: Column) -> Column:
        checks = F.lit(True)
        if min_count is not None:
            checks = checks & (m["count"] > min_count)
        if code is not None:
            checks = checks & (m["country_code"] == code)
        return checks

    return F.exists(mentions, test)


def heavy_domains(domain_info: DataFrame, min_count: int, min_weight: float, code: str | None = None,
                  strict_weight: bool = False) -> DataFrame:
    """Domains above a mention count and a weight, of any or one country."""
    weight = F.col("domain_weight")
    heavy = weight > min_weight if strict_weight else weight >= min_weight
    return domain_info.where(heavy & with_mention(F.col("country_mentions"), min_count, code))


def relevant_domains(domain_info: DataFrame, min_mentions: int = MIN_MENTIONS,
                     min_weight: float = MIN_WEIGHT) -> DataFrame:
    """Domain -> the countries it is relevant to (``codes``), one row per domain.

    A domain is relevant to a mentioning country if the mention count exceeds ``min_mentions`` or the domain's
    weight reaches ``min_weight``. Both scopes are answered from ``codes`` (``is_relevant``), so the far larger
    (target, domain) list of the international scope is never built.
    """
    codes = F.transform(
        F.filter(F.col("country_mentions"),
                 lambda m: (m["count"] > min_mentions) | (F.col("domain_weight") >= min_weight)),
        lambda m: m["country_code"])
    return (domain_info.select("domain", F.array_distinct(codes).alias("codes"))
            .where(F.size("codes") > 0))


def is_relevant(codes: Column, target_code: Column, international: Column) -> Column:
    """National: the target is among the codes. International: some other country is. NULL codes: no."""
    at_home = F.array_contains(codes, target_code)
    abroad = F.exists(codes, lambda c: c != target_code)
    return F.coalesce(F.when(international, abroad).otherwise(at_home), F.lit(False))


def domains_for(domain_info: DataFrame, code: str, international: bool = False,
                min_mentions: int = MIN_MENTIONS, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """Rows of the dimension relevant to one country, in one scope."""
    def qualifies(m: Column) -> Column:
        place = m["country_code"] != code if international else m["country_code"] == code
        return place & ((m["count"] > min_mentions) | (F.col("domain_weight") >= min_weight))

    return domain_info.where(F.exists(F.col("country_mentions"), qualifies))


def national_pairs(relevant: DataFrame) -> DataFrame:
    """(target_code, domain) of the national scope."""
    return relevant.select(F.explode("codes").alias("target_code"), "domain")


def international_counts(relevant: DataFrame, targets: DataFrame, code: str = "code") -> DataFrame:
    """Per target, how many domains are relevant in the international scope, without listing the pairs.

    All relevant domains, less those relevant to the target alone.
    """
    total = relevant.agg(F.count(F.lit(1)).alias("n"))
    only_here = (relevant.where(F.size("codes") == 1).groupBy(F.col("codes")[0].alias(code))
                 .agg(F.count(F.lit(1)).alias("__only")))
    return (targets.select(code).join(only_here, code, "left")
            .select(F.col(code).alias("target_code"),
                    (F.coalesce(total.scalar(), F.lit(0)) - F.coalesce(F.col("__only"), F.lit(0)))
                    .cast("bigint").alias("domains")))
