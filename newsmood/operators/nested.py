"""The nested row form and back.

A nested row holds arrays of headlines and ``[model][headline]`` scores of one (country, slot). A group may be far
larger than a row should be, so it is cut into parts of at most ``chunk`` positions: ``part = pos div chunk``. A group
within the chunk size is exactly one row. A part carries the position of its first headline (``first_pos``), so nothing
that is read from nested rows depends on the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.constants import INTERNATIONAL, LABELS, MODELS, NATIONAL, SCOPES
from newsmood.functions.arrays import length_or_null, subscript
from newsmood.functions.sentiment import count_struct, label, model_label, polarity
from newsmood.operators.skew import positions

CHUNK = 1_000
POSITIONS = 4_096  # headlines of a slot that are ranked together
_HEADLINE = ["title", "domain", "source_country"]
_SCORES = ["neg", "neu", "pos", "compound"]


def widen(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Long fact -> one row per headline with one score struct per model (NULL where a model is missing)."""
    scores = F.struct("neg", "neu", F.col("positive").alias("pos"), "compound")
    picks = [F.max(F.when(F.col("model") == m, scores)).alias(m) for m in MODELS]
    return scored.groupBy(*keys, "scope", "pos", *_HEADLINE).agg(*picks)


def to_nested(scored: DataFrame, keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Long fact -> nested rows per (keys, part).

    One shuffle: rows are placed by (keys, part) once, and both groupings find them already together.
    """
    keys = keys or ["target_country", "slot"]
    cell = [*keys, "part"]
    placed = (scored.withColumn("part", F.floor(F.col("pos") / chunk).cast("int"))
              .repartition(*[F.col(c) for c in cell]))
    wide = widen(placed, cell)
    item = F.struct("pos", F.struct(*_HEADLINE).alias("headline"), *MODELS)
    lists = [
        F.array_sort(F.collect_list(F.when(F.col("scope") == scope, item))).alias(scope)
        for scope in (NATIONAL, INTERNATIONAL)]
    grouped = wide.groupBy(*cell).agg(*lists)

    def headlines(scope: str) -> Column:
        return F.transform(F.col(scope), lambda r: r["headline"])

    def scores(scope: str) -> Column:
        return F.array(*[F.transform(F.col(scope), _field(m)) for m in MODELS])

    def counts(scope: str) -> Column:
        return F.array(*[_count_labels(F.col(scope), m) for m in MODELS])

    return grouped.select(
        *cell, (F.col("part") * F.lit(chunk).cast("bigint")).alias("first_pos"),
        headlines(NATIONAL).alias("headline_national"), headlines(INTERNATIONAL).alias("headline_inter"),
        scores(NATIONAL).alias("sentiment_national"), scores(INTERNATIONAL).alias("sentiment_inter"),
        counts(NATIONAL).alias("senti_count_nat"), counts(INTERNATIONAL).alias("senti_count_int"))


def to_daily(scored: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Long fact -> the daily form: nested rows per (country, day, subject, part), headlines as (title, domain).

    A headline is in the row of each of its subjects. Positions count anew in the day, by slot and position in it.
    """
    keys = ["target_country", "on_day", "on_subject"]
    order = F.struct("slot", "pos")
    rows = (scored.withColumn("on_day", F.to_date("slot")).withColumn("on_subject", F.explode("subjects"))
            .groupBy(*keys, "scope", "slot", "pos", *_HEADLINE)
            .agg(F.collect_list(F.struct("model", "neg", "neu", "positive", "compound")).alias("s")))
    placed = positions(rows, [*keys, "scope"], [order],
                       F.struct("slot", F.floor(F.col("pos") / POSITIONS).alias("piece")), "day_pos")
    long = (placed.withColumn("m", F.explode("s")).drop("pos", "slot", "s").withColumnRenamed("day_pos", "pos")
            .select(*keys, "scope", "pos", *_HEADLINE, "m.*"))
    short = lambda name: F.transform(name, lambda h: F.struct(h["title"].alias("title"), h["domain"].alias("domain")))
    wide = to_nested(long, keys, chunk)
    return wide.withColumns({c: short(c) for c in ("headline_national", "headline_inter")})


def _count_labels(rows: Column, model: str) -> Column:
    """Label counts of one model inside a nested row; headlines the model has no score for are not counted."""
    scored = F.filter(rows, lambda r: r[model].isNotNull())
    labels = F.transform(
        scored, lambda r: model_label(F.lit(model), r[model]["neg"], r[model]["pos"], r[model]["compound"]))
    return F.struct(*[F.size(F.filter(labels, _equals(n))).alias(n) for n in LABELS])


def _field(name: str):
    return lambda row: row[name]


def _equals(value: str):
    return lambda item: item == value


def unnest(nested: DataFrame, keep: list[str], scopes: list[str] = SCOPES) -> DataFrame:
    """One row per headline with both models' scores by position in the group, for the given scopes in one pass.

    Zipped before the explode: a shorter score array pads with NULL, and no array is repeated per headline. A model
    that is not there at all is an empty array, as zipping with NULL would lose the row.
    """
    def lists(scope: str) -> Column:
        suffix = "national" if scope == NATIONAL else "inter"
        arrays = {"headline": F.col(f"headline_{suffix}"),
                  **{m: subscript(F.col(f"sentiment_{suffix}"), i) for i, m in enumerate(MODELS, 1)}}
        return F.struct(F.lit(scope).alias("scope"), *[F.coalesce(a, F.array()).alias(n) for n, a in arrays.items()])

    per_scope = (nested.select(*keep, "first_pos", F.explode(F.array(*[lists(s) for s in scopes])).alias("s"))
                 .select(*keep, "first_pos", "s.*"))
    return (per_scope.select(*keep, "first_pos", "scope",
                             F.posexplode(F.arrays_zip("headline", *MODELS)).alias("at", "row"))
            .select(*keep, "scope", (F.col("first_pos") + F.col("at")).alias("pos"), "row.*"))


def unnest_scope(nested: DataFrame, scope: str, keep: list[str]) -> DataFrame:
    """``unnest`` of one scope."""
    return unnest(nested, keep, [scope])


def from_nested(nested: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nested rows -> long fact; the inverse of ``to_nested``, whatever its chunk was."""
    keys = keys or ["target_country", "slot"]
    wide = unnest(nested, keys)
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("scores")) for m in MODELS])
    return (wide.select(*keys, "scope", "pos", "headline.*", F.explode(models).alias("m"))
            .where(F.col("m.scores").isNotNull())
            .select(*keys, "scope", "pos", *_HEADLINE, "m.model", "m.scores.neg", "m.scores.neu",
                    F.col("m.scores.pos").alias("positive"), "m.scores.compound"))


def pair_models(nested: DataFrame, scope: str, keep: list[str]) -> DataFrame:
    """Both models of one headline side by side; positions without a headline are left out."""
    return unnest_scope(nested, scope, keep).where(F.col("headline").isNotNull())


def scores_per_headline(nested: DataFrame, scope: str, keep: list[str]) -> DataFrame:
    """Per headline: the lexicon compound and the classifier polarity."""
    return unnest_scope(nested, scope, keep).select(
        *keep, "pos", F.col("headline.title").alias("title"),
        F.col("lexicon.compound").alias("lexicon_compound"),
        polarity(F.col("classifier.pos"), F.col("classifier.neg")).alias("classifier_polarity"))


def nested_label_counts(nested: DataFrame, scope: str = NATIONAL) -> DataFrame:
    """The six label counts straight from nested rows: unnest, label, one-hot, sum."""
    rows = unnest_scope(nested, scope, []).select(
        count_struct(label(F.col("lexicon.compound"))).alias("lexicon"),
        count_struct(label(polarity(F.col("classifier.pos"), F.col("classifier.neg")))).alias("classifier"))
    return rows.agg(*[
        F.coalesce(F.sum(F.col(f"{m}.{n}")), F.lit(0)).cast("bigint").alias(f"{m}_{n}")
        for m in MODELS for n in LABELS])


def headline_total(nested: DataFrame, scope: str = NATIONAL, since: Column | None = None,
                   time: str = "slot") -> DataFrame:
    """How many headlines are stored, all or since a time."""
    rows = nested if since is None else nested.where(F.col(time) >= since)
    column = "headline_national" if scope == NATIONAL else "headline_inter"
    amount = F.when(F.col(column).isNotNull(), F.size(F.array_compact(column)))
    return rows.agg(F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("headline_amount"))


def headline_lengths(nested: DataFrame, keys: list[str]) -> DataFrame:
    """Headlines per key and scope; NULL where there are none. Parts of a key are added up."""
    return (nested.groupBy(*keys)
            .agg(F.sum(length_or_null(F.col("headline_national"))).alias("head_nat"),
                 F.sum(length_or_null(F.col("headline_inter"))).alias("head_int"))
            .orderBy(*keys))
