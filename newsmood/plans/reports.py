"""Reports over the counts rollup: per slot, per country, net scores, regions, completeness, response rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.constants import (CLASSIFIER, INTERNATIONAL, LABELS, LEXICON, NATIONAL, NO_SCORE, WORLD)
from newsmood.functions.arrays import format_composite
from newsmood.functions.sentiment import net_score, sum_counts
from newsmood.functions.text import country_prefix
from newsmood.functions.timing import hour_key

# Response order: model within scope.
CELLS = [(LEXICON, NATIONAL), (CLASSIFIER, NATIONAL), (LEXICON, INTERNATIONAL), (CLASSIFIER, INTERNATIONAL)]
_SHORT = {NATIONAL: "nat", INTERNATIONAL: "int"}
CELL_NAMES = [f"{m}_{_SHORT[s]}" for m, s in CELLS]


def _cells(counts: DataFrame, keys: list[str], null_policy: str) -> DataFrame:
    """Long counts -> one counts struct per model and scope.

    A cell the group has no row for is NULL, as the subscript of a missing model is. ``propagate`` has to tell
    that from rows that are there with NULL counts, so each cell counts its own rows.
    """
    def cell(model: str, scope: str, name: str) -> Column:
        here = (F.col("model") == model) & (F.col("scope") == scope)
        fields = []
        for lab in LABELS:
            value = F.when(here, F.col(lab))
            total = F.sum(value).cast("bigint")
            if null_policy == "propagate":
                total = F.when(F.count(value) == F.count_if(here), total)
            fields.append(total.alias(lab))
        return F.when(F.count_if(here) > 0, F.struct(*fields)).alias(name)

    return counts.groupBy(*keys).agg(*[cell(m, s, n) for (m, s), n in zip(CELLS, CELL_NAMES)])


def counts_by_slot(counts: DataFrame, country: str | None = None, since: Column | None = None,
                   null_policy: str = "propagate") -> DataFrame:
    """Four counts structs per (country, slot), of all countries or one.

    ``country`` None or ``World`` means no filter; with a filter the placeholder country ``none`` is left out too.
    """
    rows = counts
    if country is not None and country != WORLD:
        rows = rows.where((F.col("target_country") == country) & (F.col("target_country") != "none"))
    if since is not None:
        rows = rows.where(F.col("slot") >= since)
    return _cells(rows, ["target_country", "slot"], null_policy)


def counts_by_slot_for_code(counts: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """``counts_by_slot`` for a country code; an unknown code means all countries.

    The name is looked up inside the query as a scalar, so nothing is fetched to build the plan.
    """
    name = codes.where(F.col("code") == code).agg(F.min("name").alias("name")).scalar()
    picked = F.coalesce(name, F.lit(WORLD))
    rows = counts.where((picked == WORLD)
                        | ((F.col("target_country") == picked) & (F.col("target_country") != "none")))
    return _cells(rows, ["target_country", "slot"], "propagate")


def counts_by_country(counts: DataFrame, null_policy: str = "propagate") -> DataFrame:
    return _cells(counts, ["target_country"], null_policy)


def sum_struct_by(df: DataFrame, counts: str, keys: list[str], null_policy: str = "propagate") -> DataFrame:
    """The counts aggregate on a struct column."""
    return df.groupBy(*keys).agg(sum_counts(F.col(counts), null_policy).alias(counts))


def as_response(cells: DataFrame, codes: DataFrame) -> DataFrame:
    """One JSON array per row: code, four composites, slot key if counted by slot, name.

    A country without a code is an error.
    """
    from newsmood.operators.dims import with_code
    coded = with_code(cells, codes, "target_country", "country_code", unknown="error")
    slot = ["slot"] if "slot" in cells.columns else []
    texts = [format_composite(F.col(c)) for c in CELL_NAMES]
    row = F.array(F.col("country_code"), *texts, *[hour_key(F.col(c)) for c in slot], F.col("target_country"))
    return coded.select("target_country", *slot, F.to_json(row).alias("response"))


def in_mode(counts: DataFrame, mode: str) -> DataFrame:
    if mode not in (NATIONAL, INTERNATIONAL):
        raise ValueError(f"mode: {mode}")
    return counts.where(F.col("scope") == mode)


def _net(counts: DataFrame, keys: list[str]) -> DataFrame:
    sums = counts.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in LABELS])
    return sums.withColumn("net", net_score(F.col("negative"), F.col("neutral"), F.col("positive")))


def net_score_series(counts: DataFrame, mode: str = INTERNATIONAL) -> DataFrame:
    """Both models together per (country, slot), in time order."""
    return _net(in_mode(counts, mode), ["target_country", "slot"]).orderBy("target_country", "slot")


def net_score_total(counts: DataFrame, mode: str = INTERNATIONAL) -> DataFrame:
    """Both models and all slots together per country."""
    return _net(in_mode(counts, mode), ["target_country"])


def region_scores(regions: DataFrame, totals: DataFrame, region: str = "region_name", code: str = "country_code",
                  missing: float | None = NO_SCORE) -> DataFrame:
    """Regions with the net score of the country their name starts with; ``missing`` where there is none."""
    scores = totals.select(F.col(code).alias("__code"), "net")
    joined = (regions.withColumn("__code", country_prefix(F.col(region)))
              .join(scores.withColumn("__scored", F.lit(True)), "__code", "left"))
    value = F.when(F.col("__scored"), F.col("net")).otherwise(F.lit(missing).cast("double"))
    return joined.withColumn("sentiment", value).drop("__code", "net", "__scored")


def slot_map(by_slot: DataFrame) -> DataFrame:
    """One row per country: slot key -> its four counts. Slots of a country are few and unique (six a day)."""
    entry = F.struct(hour_key(F.col("slot")).alias("key"), F.struct(*CELL_NAMES).alias("value"))
    return by_slot.groupBy("target_country").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("slots"))


def rows_per(nested: DataFrame, keys: list[str]) -> DataFrame:
    """Nested rows per key. A (country, slot) that is cut into parts is one row; every one has a part 0."""
    return nested.where("part = 0").groupBy(*keys).agg(F.count(keys[0]).alias("rows"))
