"""The registered queries. Every one takes (spark, sf_dir), reads whole tables and returns a DataFrame."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood import schemas
from newsmood.constants import CLASSIFIER, INTERNATIONAL, LEXICON, NATIONAL, OUTLET_MARK
from newsmood.functions import arrays, sentiment, text, timing
from newsmood.functions.timing import hour_key
from newsmood.operators import articles as art
from newsmood.operators import dims, domains, labels, models, nested, outlets, translation
from newsmood.operators import lexicon as lex
from newsmood.operators.skew import positions_by_range
from newsmood.plans import deltas, ingest, reports
from newsmood.sources import readers, writers
from newsmood.sources.shared import fresh_path, materialise
from newsmood.sources.writers import batch_name
from newsmood.streaming import load as stream_plan
from newsmood.streaming import slots as stream
from workload import fixtures as fx

KEY = fx.slot_key
GROUP = art.GROUP


def _flat(df: DataFrame, names=reports.CELL_NAMES) -> list:
    return [F.col(f"{n}.{f}").alias(f"{n}_{f}") for n in names for f in ("negative", "neutral", "positive")]


def _r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


# ---- label counts -------------------------------------------------------------------------------------------

def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_counts(fx.scores(spark, sf))


def label_counts_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return fx.counts(spark, sf).select("target_country", KEY(), "scope", "model", "negative", "neutral", "positive")


def label_counts_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The label counts through the SQL functions, by country and model."""
    sentiment.register_sql_functions(spark)
    return spark.sql("""
        WITH labelled AS (
            SELECT target_country, model, senti_count(senti_label(
                CASE WHEN model = 'lexicon' THEN compound ELSE tanh(positive - neg) END)) AS c FROM {scores})
        SELECT target_country, model, sum(c.negative) AS negative, sum(c.neutral) AS neutral,
               sum(c.positive) AS positive
        FROM labelled GROUP BY target_country, model""", scores=fx.scores(spark, sf))


def counts_by_country_slot(spark: SparkSession, sf: str) -> DataFrame:
    df = reports.counts_by_slot(fx.counts(spark, sf))
    return df.select("target_country", KEY(), *_flat(df))


def counts_by_country(spark: SparkSession, sf: str) -> DataFrame:
    df = reports.counts_by_country(fx.counts(spark, sf))
    return df.select("target_country", *_flat(df))


def counts_one_country(spark: SparkSession, sf: str) -> DataFrame:
    df = reports.counts_by_slot_for_code(fx.counts(spark, sf), fx.codes(spark, sf), "03")
    return df.select("target_country", KEY(), *_flat(df))


def counts_unknown_code(spark: SparkSession, sf: str) -> DataFrame:
    df = reports.counts_by_slot_for_code(fx.counts(spark, sf), fx.codes(spark, sf), "ZZ")
    return df.select("target_country", KEY(), *_flat(df))


def counts_missing_model(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.gappy_counts(spark, sf).groupBy("lang", "size_class").agg(
        sentiment.sum_counts(F.col("counts")).alias("strict"),
        sentiment.sum_counts(F.col("counts"), "skip").alias("lenient"))
    return df.select("lang", "size_class", *_flat(df, ["strict", "lenient"]))


def avg_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = labels.average_scores(fx.wide_scores(spark, sf))
    return df.select(*[_r6(c) for c in df.columns])


def label_counts_day_subject(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_counts(fx.scores(spark, sf), day=F.lit("2025-01-01").cast("date"), subject="Economy")


# ---- nested form ---------------------------------------------------------------------------------------------

def headline_total(spark: SparkSession, sf: str) -> DataFrame:
    return nested.headline_total(fx.nested_with_gaps(spark, sf))


def headline_count_since(spark: SparkSession, sf: str) -> DataFrame:
    return nested.headline_total(fx.nested_with_gaps(spark, sf), since=timing.ntz("2025-01-01 12:00:00"))


def nested_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return nested.nested_label_counts(fx.nested_with_gaps(spark, sf))


def nested_counts_by_country(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the stored counts by subscript; the third model does not exist and gives NULL."""
    rows = fx.nested(spark, sf)
    df = rows.groupBy("target_country").agg(*[
        sentiment.sum_counts(arrays.subscript(F.col(c), i)).alias(f"{c}_{i}")
        for c in ("senti_count_nat", "senti_count_int") for i in (1, 2, 3)])
    return df.select("target_country", *_flat(df, [c for c in df.columns if c != "target_country"]))


def rows_per_country(spark: SparkSession, sf: str) -> DataFrame:
    return reports.rows_per(fx.nested_with_gaps(spark, sf, chunk=3), ["target_country"]).orderBy("target_country")


def rows_per_country_day(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.nested_with_gaps(spark, sf, chunk=3).withColumn("day", timing.day_key(F.col("slot")))
    return reports.rows_per(df, ["target_country", "day"]).orderBy("target_country", "day")


def headline_lengths(spark: SparkSession, sf: str) -> DataFrame:
    df = nested.headline_lengths(fx.nested_with_gaps(spark, sf), ["target_country", "slot"])
    return df.select("target_country", KEY(), F.col("head_nat").cast("bigint"), F.col("head_int").cast("bigint"))


def scores_per_headline(spark: SparkSession, sf: str) -> DataFrame:
    df = nested.scores_per_headline(fx.nested(spark, sf, chunk=3), NATIONAL, ["target_country", "slot"])
    return df.select("target_country", KEY(), "pos", "title", "lexicon_compound", _r6("classifier_polarity"))


def pair_models(spark: SparkSession, sf: str) -> DataFrame:
    df = nested.pair_models(fx.nested_with_gaps(spark, sf, chunk=3), INTERNATIONAL, ["target_country", "slot"])
    return df.select("target_country", KEY(), "pos", F.col("headline.title").alias("title"),
                     F.col("lexicon.compound").alias("lexicon_compound"),
                     _r6("classifier.compound", "classifier_compound"))


def second_model_slice(spark: SparkSession, sf: str) -> DataFrame:
    """``[2:2]`` of the score arrays, unnested."""
    df = fx.nested(spark, sf).select("target_country", "slot", F.inline(
        arrays.one_slice(F.col("sentiment_national"), 2)))
    return (df.groupBy("target_country", KEY())
            .agg(F.count("neg").alias("n"), F.round(F.sum("neg"), 4).alias("neg"),
                 F.round(F.sum("pos"), 4).alias("pos")))


def nested_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    df = nested.from_nested(fx.nested_with_gaps(spark, sf, chunk=3))
    return df.select("target_country", KEY(), "scope", "pos", "title", "domain", "source_country", "model",
                     "neg", "neu", "positive", _r6("compound"))


def nested_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The daily form, headline by headline."""
    daily = nested.to_daily(fx.placed_scores(spark, sf), chunk=3)
    rows = nested.unnest(daily, ["target_country", "on_day", "on_subject"])
    return rows.select(
        "target_country", F.date_format("on_day", "yyyyMMdd").alias("day"), "on_subject", "scope", "pos",
        F.col("headline.title").alias("title"), F.col("headline.domain").alias("domain"),
        F.col("lexicon.compound").alias("lexicon_compound"), F.col("classifier.neg").alias("classifier_neg"))


# ---- scores ---------------------------------------------------------------------------------------------------

def softmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    return fx.wide_scores(spark, sf).select("vec_id", "classifier.neg", "classifier.neu", "classifier.pos")


def three_class_compound(spark: SparkSession, sf: str) -> DataFrame:
    return fx.wide_scores(spark, sf).select("vec_id", _r6("classifier.compound", "compound"))


# ---- net scores ------------------------------------------------------------------------------------------------

def net_score_series(spark: SparkSession, sf: str) -> DataFrame:
    df = reports.net_score_series(fx.counts(spark, sf), INTERNATIONAL)
    return df.select("target_country", KEY(), "negative", "neutral", "positive", _r6("net"))


def net_score_total(spark: SparkSession, sf: str) -> DataFrame:
    df = reports.net_score_total(fx.counts(spark, sf), NATIONAL)
    return df.select("target_country", "negative", "neutral", "positive", _r6("net"))


def region_scores(spark: SparkSession, sf: str) -> DataFrame:
    totals = dims.with_code(reports.net_score_total(fx.counts(spark, sf)), fx.codes(spark, sf), "target_country")
    df = reports.region_scores(fx.regions(spark, sf), totals)
    return df.select("region_name", _r6("sentiment"))


def country_slot_map(spark: SparkSession, sf: str) -> DataFrame:
    df = reports.slot_map(reports.counts_by_slot(fx.counts(spark, sf)))
    rows = df.select("target_country", F.explode("slots").alias("slot_key", "v"))
    return rows.select("target_country", "slot_key", *_flat_map())


def _flat_map():
    return [F.col(f"v.{n}.{f}").alias(f"{n}_{f}") for n in reports.CELL_NAMES
            for f in ("negative", "neutral", "positive")]


def response_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = reports.as_response(reports.counts_by_slot(fx.counts(spark, sf)), fx.codes(spark, sf))
    return df.select("target_country", KEY(), "response")


def response_by_country(spark: SparkSession, sf: str) -> DataFrame:
    return reports.as_response(reports.counts_by_country(fx.counts(spark, sf)), fx.codes(spark, sf))


def composite_parse(spark: SparkSession, sf: str) -> DataFrame:
    counts = fx.counts(spark, sf)
    written = arrays.format_composite(F.struct("negative", "neutral", "positive"))
    parsed = counts.withColumn("composite", written).withColumn("n", arrays.parse_composite(F.col("composite")))
    return parsed.select("target_country", KEY(), "scope", "model", "composite",
                         *[F.col("n")[i].cast("bigint").alias(f"n{i}") for i in range(3)])


# ---- articles -------------------------------------------------------------------------------------------------

def subject_match(spark: SparkSession, sf: str) -> DataFrame:
    return art.scope_pairs(fx.articles(spark, sf), fx.COUNTRY_TERMS, fx.SUBJECTS, by=["doc_id"]).select(
        "doc_id", "target_country", F.array_join("subjects", "|").alias("subjects"))


def scope_split(spark: SparkSession, sf: str) -> DataFrame:
    named = text.with_scope_prefix(F.col("target_country"), F.col("scope") == INTERNATIONAL)
    return (fx.pairs(spark, sf).groupBy("target_country", "scope", named.alias("query_name"))
            .agg(F.count(F.lit(1)).alias("articles"))
            .withColumn("plain_name", text.strip_scope_prefix(F.col("query_name"))))


def both_scope_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.pairs(spark, sf)
    return art.scope_totals(rows, ["target_country", "slot"]).select("target_country", KEY(), "articles")


def dedup_titles(spark: SparkSession, sf: str) -> DataFrame:
    df = art.dedup_titles(fx.pairs(spark, sf), GROUP, [F.col("doc_id")])
    return df.select("target_country", "scope", KEY(), "doc_id")


def cap_per_group(spark: SparkSession, sf: str) -> DataFrame:
    df = art.cap_per_group(fx.pairs(spark, sf), GROUP, [F.col("seen").desc(), F.col("doc_id")], by=["doc_id"], n=10)
    return df.select("target_country", "scope", KEY(), "doc_id")


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return art.with_relevance(fx.pairs(spark, sf), fx.relevant(spark, sf), by=["doc_id"])


def relevant_articles(spark: SparkSession, sf: str) -> DataFrame:
    # Read twice, by the fallback test and by the result, so it is written once, as the load does.
    flagged = materialise(_flagged(spark, sf).select("doc_id", *GROUP, "relevant"), "flagged")
    df = art.keep_relevant(flagged, GROUP, by=["doc_id"])
    return df.select("target_country", "scope", KEY(), "doc_id", "relevant")


def relevance_counters(spark: SparkSession, sf: str) -> DataFrame:
    return art.relevance_counters(_flagged(spark, sf), ["target_country", "scope"])


def language_volume(spark: SparkSession, sf: str) -> DataFrame:
    return art.language_volume(fx.articles(spark, sf))


def translated_titles(spark: SparkSession, sf: str) -> DataFrame:
    df = art.translate_titles(fx.articles(spark, sf), fx.translations(spark, sf), english=fx.ENGLISH, by=["doc_id"])
    return df.select("doc_id", "language", "domain", "title")


def translate_hook(spark: SparkSession, sf: str) -> DataFrame:
    """A translator that fails on every seventh length."""
    def translator(language: str, titles: list[str]) -> list:
        return [None if len(t) % 7 == 0 else f"[{language}] {t}" for t in titles]

    rows = fx.articles(spark, sf).select("doc_id", "language", "title")
    return art.translate_titles(rows, translator=translator, english=fx.ENGLISH)


def classify_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.documents(spark, sf).select("doc_id", F.col("text").alias("title"))
    return models.classify(rows, fx.make_scorer).select("doc_id", "neg", "neu", "positive", _r6("compound"), "label")


def classify_once(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents, then all documents, by a model whose scores are stored: each text is scored once."""
    path = fresh_path(spark, "scores")
    rows = fx.documents(spark, sf).select("doc_id", F.col("text").alias("title"))
    labelled = rows.join(fx.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    models.classify_once(labelled, fx.make_scorer, path, by=["doc_id"])
    scored = models.classify_once(rows, fx.make_scorer, path, by=["doc_id"])
    return scored.select("doc_id", "neg", "neu", "positive", _r6("compound"), "label")


def translation_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The batches in which the different titles go to a translator."""
    titles = translation.different_titles(fx.articles(spark, sf), english=fx.ENGLISH)
    return translation.batches(titles, 150, 40_000).select("language", "digest", "chars", "batch")


def translation_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of the labelled documents, then those of all: the second run asks for new titles and earlier failures."""
    def translator(run: int, fails: int):
        return lambda language, titles: [None if len(t) % fails == 0 else f"[{run} {language}] {t}" for t in titles]

    path = fresh_path(spark, "memory")
    rows = fx.articles(spark, sf).select("doc_id", "language", "title")
    labelled = rows.join(fx.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    translation.remember(labelled, path, translator(1, 7), english=fx.ENGLISH, budget=40_000)
    memory = translation.remember(rows, path, translator(2, 11), english=fx.ENGLISH, budget=40_000)
    done = translation.from_memory(rows, memory, english=fx.ENGLISH, by=["doc_id"])
    return done.select("doc_id", "language", F.sha2("title", 256).alias("title_sha"))


# ---- the load -------------------------------------------------------------------------------------------------

def _fact(rows: DataFrame) -> DataFrame:
    return rows.select("target_country", KEY(), "scope", "model", F.sha2("title", 256).alias("title_sha"), "domain",
                       "source_country", F.array_join("subjects", "|").alias("subjects"),
                       F.round("neg", 4).alias("neg"), F.round("neu", 4).alias("neu"),
                       F.round("positive", 4).alias("positive"), _r6("compound"),
                       F.date_format("day", "yyyyMMdd").alias("day"))


def load_scored(spark: SparkSession, sf: str) -> DataFrame:
    """The whole load over documents that have landed twice, with translations, a lexicon and a classifier."""
    path = fresh_path(spark, "landed")
    fx.payloads(fx.articles(spark, sf)).write.text(path)
    spark.read.text(path).write.mode("append").text(path)  # the payloads are put together once
    # stored, so that its size is known when the join is planned
    relevant = materialise(fx.relevant(spark, sf), "relevant")
    fact = ingest.load(readers.read_articles(spark, path), fx.COUNTRY_TERMS, fx.codes(spark, sf), relevant,
                       lexicon=fx.lexicon(spark), make_scorer=fx.make_scorer, translations=fx.translations(spark, sf),
                       subjects=fx.SUBJECTS, english=fx.ENGLISH)
    return _fact(fact)


def stream_load(spark: SparkSession, sf: str) -> DataFrame:
    """The load as a stream: documents land in three batches, each twice; the result are the slots closed by then."""
    path = fresh_path(spark, "stream-load")
    codes, lexicon = fx.codes(spark, sf), fx.lexicon(spark)
    relevant = materialise(fx.relevant(spark, sf), "relevant")
    translations = materialise(fx.translations(spark, sf), "translations")
    rows = fx.articles(spark, sf)
    for n, first in enumerate(("2025-01-01 00:00:00", "2025-01-01 08:00:00", "2025-01-01 16:00:00")):
        slot = F.col("slot")
        landing = rows.where((slot >= timing.ntz(first)) & (slot < timing.shift_hours(timing.ntz(first), 8)))
        landed = f"{path}/landed/{n}"
        fx.payloads(landing).write.text(landed)
        spark.read.text(landed).write.mode("append").text(landed)  # the payloads are put together once
        titles = stream_plan.closed_titles(stream_plan.read_articles(spark, f"{path}/landed/*"), fx.COUNTRY_TERMS, "1 hour",
                                           fx.SUBJECTS)
        stream_plan.start_load(titles, f"{path}/fact", f"{path}/checkpoint", codes, relevant, lexicon, fx.make_scorer,
                               translations, fx.ENGLISH).awaitTermination()
    return _fact(readers.read_fact(spark, f"{path}/fact"))


def load_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Kept and removed articles of every group, counted while the flagged articles are written, and the payloads that
    cannot be read: every payload has also landed cut off in the middle."""
    path, lines = fresh_path(spark, "landed"), fx.payloads(fx.articles(spark, sf))
    # both in one pass, as the payloads are put together out of all texts
    lines.select(F.explode(F.array("value", F.expr("left(value, length(value) div 2)"))).alias("value")).write.text(path)
    payloads = readers.read_payloads(spark, path)
    pairs = art.scope_pairs(readers.article_rows(payloads.drop("broken")), fx.COUNTRY_TERMS, None, by=["url"])
    # stored, so that its size is known when the join is planned and no text is shuffled for a table that can be broadcast
    relevant = materialise(fx.relevant(spark, sf), "relevant")
    flagged = ingest.with_flags(pairs, fx.codes(spark, sf), relevant)
    groups = [(c, s) for c in fx.COUNTRY_TERMS for s in (NATIONAL, INTERNATIONAL)]
    counters = ingest.write_counted(flagged, fresh_path(spark, "flagged"), groups)
    # read once more instead of stored: Spark does not read that column alone, so the articles go along
    any_size = F.coalesce(F.size("articles"), F.lit(0)) >= 0
    broken = payloads.agg(F.count_if(F.col("broken").isNotNull() & any_size).alias("n"))
    return counters.unionByName(broken.select(
        F.lit("").alias("target_country"), F.lit("").alias("scope"), F.lit("broken").alias("kind"), "n"))


def rollup_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """The counts rollup after three batches: national headlines, international ones, and all classifier scores replaced
    by their mirror image; the second batch is run again after the third."""
    path, fact = fresh_path(spark, "rollup"), materialise(fx.scores(spark, sf), "fact")
    scored = fact.where(F.col("model") == CLASSIFIER)
    mirrored = scored.withColumns({"neg": F.col("positive"), "positive": F.col("neg"), "compound": -F.col("compound")})
    batches = [deltas.delta(added=fact.where(F.col("scope") == NATIONAL)),
               deltas.delta(added=fact.where(F.col("scope") == INTERNATIONAL)),
               deltas.delta(added=mirrored, withdrawn=scored)]
    for number in (0, 1, 2, 1):
        deltas.merge(batches[number], path, number)
    return deltas.read(spark, path, batches[0]).select(
        "target_country", KEY(), "scope", "model", "negative", "neutral", "positive")


def phrase_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """The lexicon model with all phrases of the documents themselves as idioms."""
    return lex.lexicon_score(fx.documents(spark, sf), fx.lexicon(spark), "text", ["doc_id"], fx.phrases(spark, sf))


# ---- time -----------------------------------------------------------------------------------------------------

def slot_window(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the day before and of the four hours before a time."""
    ts, end = F.col("ts"), timing.ntz("2024-01-15 08:00:00")
    return fx.table(spark, sf, "events").groupBy("event_type").agg(
        F.count_if(timing.in_slot(ts, end)).alias("in_slot"),
        F.count_if(timing.in_slot(ts, end, 24)).alias("in_day"))


def slot_series(spark: SparkSession, sf: str) -> DataFrame:
    """The backfill series from the first event's slot, with the events of each slot."""
    events = fx.table(spark, sf, "events")
    per_slot = events.groupBy(timing.slot_start(F.col("ts")).alias("slot")).agg(F.count(F.lit(1)).alias("events"))
    start = events.agg(timing.slot_start(F.min("ts")).alias("start"))
    series = start.select(F.explode(timing.slot_array(F.col("start"))).alias("slot"))
    return series.join(per_slot, "slot", "left").select(
        KEY(), F.coalesce("events", F.lit(0)).cast("bigint").alias("events"))


def time_keys(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return fx.table(spark, sf, "events").select(
        "event_id", timing.second_key(ts).alias("second_key"), timing.hour_key(ts).alias("hour_key"),
        timing.day_key(ts).alias("day_key"), timing.second_key(timing.shift_days(ts, -1)).alias("day_before"),
        timing.second_key(timing.shift_hours(ts, -4)).alias("slot_before"),
        timing.second_key(timing.hour_start(ts)).alias("hour_start"),
        timing.epoch_seconds(ts).alias("epoch"),
        timing.second_key(timing.from_epoch_seconds(timing.epoch_seconds(ts))).alias("epoch_back"))


def pending_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Work grid of all nations over the stored slots and one more, less what is stored in both scopes."""
    stored = art.both_scopes(fx.counts(spark, sf), ["target_country", "slot"])
    slots = fx.counts(spark, sf).select("slot").distinct()
    grid = dims.work_grid_from(
        slots.select("slot").union(slots.agg(timing.shift_hours(F.max("slot"), 4).alias("slot"))),
        fx.table(spark, sf, "nation"), "n_name")
    return art.pending(grid, stored, ["target_country", "slot"]).select("target_country", KEY())


def pending_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a table that is stored in buckets by country and slot."""
    name = "clustered_" + uuid.uuid4().hex
    writers.save_clustered(fx.counts(spark, sf), name, ["target_country", "slot"], 8, fresh_path(spark, "clustered"))
    stored = spark.table(name)
    slots = stored.select("slot").distinct()
    grid = dims.work_grid_from(
        slots.union(slots.agg(timing.shift_hours(F.max("slot"), 4).alias("slot"))), fx.table(spark, sf, "nation"), "n_name")
    return art.pending(grid, art.both_scopes(stored, ["target_country", "slot"]), ["target_country", "slot"]).select(
        "target_country", KEY())


# ---- domains --------------------------------------------------------------------------------------------------

def domain_mentions(spark: SparkSession, sf: str) -> DataFrame:
    df = domains.collect_mentions(fx.mentions(spark, sf))
    rows = df.select("domain", F.posexplode("country_mentions").alias("place", "m"))
    return rows.select("domain", "place", F.col("m.country_code").alias("code"), F.col("m.count").alias("cnt"))


def domain_weight(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.ranks(fx.mentions(spark, sf))
    return df.select("domain", "code", "rank", F.round(sentiment.domain_weight(F.col("rank")), 6).alias("weight"))


def domain_best_rank(spark: SparkSession, sf: str) -> DataFrame:
    return fx.domain_info(spark, sf).select("domain", "country_code", _r6("domain_weight"),
                                            F.size("country_mentions").cast("bigint").alias("countries"))


def domain_authority(spark: SparkSession, sf: str) -> DataFrame:
    return fx.domain_info(spark, sf).select("domain", "change_date", "domain_auth")


def domain_authority_missing(spark: SparkSession, sf: str) -> DataFrame:
    return domains.unmatched_authority(fx.mentions(spark, sf), fx.authority(spark, sf))


def relevant_domains_national(spark: SparkSession, sf: str) -> DataFrame:
    return domains.national_pairs(fx.relevant(spark, sf))


def relevant_domains_international(spark: SparkSession, sf: str) -> DataFrame:
    return domains.international_counts(fx.relevant(spark, sf), fx.codes(spark, sf))


def domains_for_country(spark: SparkSession, sf: str) -> DataFrame:
    info = fx.domain_info(spark, sf)
    home = domains.domains_for(info, "07", False, fx.MIN_MENTIONS, fx.MIN_WEIGHT)
    away = domains.domains_for(info, "07", True, fx.MIN_MENTIONS, fx.MIN_WEIGHT)
    return (home.select("domain", F.lit(NATIONAL).alias("scope"))
            .unionByName(away.select("domain", F.lit(INTERNATIONAL).alias("scope"))))


def heavy_domains(spark: SparkSession, sf: str) -> DataFrame:
    info = fx.domain_info(spark, sf)
    anywhere = domains.heavy_domains(info, 38, 0.1, strict_weight=True)
    one = domains.heavy_domains(info, 25, 0.5, code="07")
    return (anywhere.select("domain", F.lit("anywhere").alias("kind"))
            .unionByName(one.select("domain", F.lit("one country").alias("kind"))))


def country_code_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of nations and, passing through, of names that are no nation."""
    names = (fx.table(spark, sf, "nation").select(F.col("n_name").alias("country"))
             .unionByName(fx.table(spark, sf, "region").select(F.col("r_name").alias("country"))))
    aliased = dims.with_alias(names, {"ASIA": "NATION_3", "EUROPE": "EU ROPE"}, "country")
    return dims.with_code(aliased, fx.codes(spark, sf), "country").withColumn(
        "squeezed", text.squeeze(F.col("country")))


def code_to_country(spark: SparkSession, sf: str) -> DataFrame:
    """Country names of the customers' codes; every third key has no code."""
    used = fx.table(spark, sf, "customer").groupBy(
        F.lpad((F.col("c_nationkey") + F.floor(F.col("c_acctbal") / 500)).cast("string"), 2, "0").alias("code")
    ).agg(F.count(F.lit(1)).alias("customers"))
    return dims.with_name(used, fx.codes(spark, sf), "code")


def registered_codes(spark: SparkSession, sf: str) -> DataFrame:
    return dims.registered_codes(fx.domain_info(spark, sf))


def unique_domains(spark: SparkSession, sf: str) -> DataFrame:
    return domains.unique_domains(fx.mentions(spark, sf)).select("domain")


def batch_names(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("s"))
    return df.select("event_id", batch_name("processed", F.date_format("s", "yyyy-MM-dd HH:mm:ss")).alias("name"))


def try_casts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers out of part types and names; most are none."""
    raw = F.regexp_replace("p_brand", "Brand#", "")
    return fx.table(spark, sf, "part").select(
        "p_partkey", raw.try_cast("int").alias("brand_no"), F.col("p_brand").try_cast("int").alias("no_number"),
        F.col("p_retailprice").cast("string").try_cast("double").alias("price"))


# ---- text -----------------------------------------------------------------------------------------------------

def mask_handles(spark: SparkSession, sf: str) -> DataFrame:
    return fx.handle_texts(spark, sf).select("doc_id", text.mask_handles(F.col("text")).alias("masked"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lex.token_counts(fx.documents(spark, sf), "text")


def lexicon_sum(spark: SparkSession, sf: str) -> DataFrame:
    return lex.lexicon_sum(fx.documents(spark, sf), fx.lexicon(spark), "text", ["doc_id"])


def lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    return lex.lexicon_score(fx.spoken_documents(spark, sf), fx.lexicon(spark), "text", ["doc_id"], fx.IDIOMS)


def outlet_extract(spark: SparkSession, sf: str) -> DataFrame:
    df = outlets.extract_outlets(fx.outlet_pages(spark, sf), "text", ["page_id"])
    return df.withColumn("record", F.col("record").cast("bigint"))


# ---- streaming ------------------------------------------------------------------------------------------------

def stream_slot_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Label counts per slot and event type, computed by a stream over the events file."""
    schema = fx.table(spark, sf, "events").schema
    events = stream.read_stream(spark, sf, schema, "events.parquet")
    rows = stream.with_watermark(fx.labelled_events(events), "ts", "1 hour")
    counts = stream.slot_counts(rows, ["event_type"])
    path = fresh_path(spark, "slot-counts")
    stream.start_counts(counts, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return stream.latest(spark, f"{path}/table", counts.schema).select(
        KEY(), "event_type", "negative", "neutral", "positive")


def batch_slot_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts from the table."""
    rows = fx.labelled_events(fx.table(spark, sf, "events")).withColumn("instant", timing.to_instant(F.col("ts")))
    return stream.slot_counts(rows, ["event_type"]).select(KEY(), "event_type", "negative", "neutral", "positive")


def stream_append_once(spark: SparkSession, sf: str) -> DataFrame:
    """Events landed in four files, appended file by file, and once more by a stream that has lost its checkpoint."""
    events = fx.labelled_events(fx.table(spark, sf, "events")).withColumn("day", F.to_date("ts"))
    path = fresh_path(spark, "append")
    events.repartition(4, "event_id").write.parquet(f"{path}/landed")
    for run in range(2):
        landed = stream.read_stream(spark, f"{path}/landed", events.schema, files_per_trigger=1)
        stream.start_append(landed, f"{path}/table", f"{path}/checkpoint{run}", ["event_id"]).awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{path}/table").select(
        "event_id", "event_type", "label", F.date_format("day", "yyyyMMdd").alias("day"))


def stream_append_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Days and types that are not known are null: appended twice by streams that have lost their checkpoints, the rows
    are there once."""
    events = fx.labelled_events(fx.table(spark, sf, "events")).select(
        "event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("event_type"), "label",
        F.when(F.col("label") != "neutral", F.to_date("ts")).alias("day"))
    path = fresh_path(spark, "append")
    events.repartition(4, "event_id").write.parquet(f"{path}/landed")
    for run in range(2):
        landed = stream.read_stream(spark, f"{path}/landed", events.schema, files_per_trigger=2)
        stream.start_append(landed, f"{path}/table", f"{path}/checkpoint{run}", ["event_type", "event_id"]).awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{path}/table").select(
        "event_id", "event_type", "label", F.date_format("day", "yyyyMMdd").alias("day"))


def stream_dedup_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of a stream of articles, each once, over the borders of batches."""
    rows = fx.articles(spark, sf).select(F.sha2("title", 256).alias("title_sha"), "seen")
    path = fresh_path(spark, "dedup")
    rows.repartition(3, "seen").write.parquet(f"{path}/landed")
    landed = stream.read_stream(spark, f"{path}/landed", rows.schema, files_per_trigger=1)
    unique = stream.dedup_stream(stream.with_watermark(landed, "seen", "2 days"), ["title_sha"]).select("title_sha")
    (unique.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
     .trigger(availableNow=True).format("parquet").start(f"{path}/table").awaitTermination())
    return spark.read.schema(unique.schema).parquet(f"{path}/table")


def stream_closed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the slots that the watermark has passed, each written once."""
    schema = fx.table(spark, sf, "events").schema
    rows = stream.with_watermark(
        fx.labelled_events(stream.read_stream(spark, sf, schema, "events.parquet")), "ts", "1 hour")
    counts = stream.slot_counts(rows, ["event_type"])
    path = fresh_path(spark, "closed")
    stream.start_closed_counts(counts, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/table").select(
        KEY(), "event_type", "negative", "neutral", "positive")


def backfill_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all events in the 58 slots from the first one on, in one pass."""
    events = fx.labelled_events(fx.table(spark, sf, "events"))
    start = events.agg(timing.slot_start(F.min("ts")).alias("start"))
    slots = start.select(F.explode(timing.slot_array(F.col("start"))).alias("slot"))
    return (stream.backfill(events, slots, "ts").groupBy(KEY(), "event_type")
            .agg(*sentiment.tally(F.col("label"))))


# ---- files ----------------------------------------------------------------------------------------------------

def article_files(spark: SparkSession, sf: str) -> DataFrame:
    """Articles as landed payloads of seven, and read again."""
    path = fresh_path(spark, "articles")
    fx.payloads(fx.articles(spark, sf)).write.text(path)
    return readers.read_articles(spark, path).select(
        "url", F.sha2("title", 256).alias("title_sha"), second_key_of("seen"), "domain", "language", "source_country",
        F.col("arrival").cast("bigint").alias("arrival"))


def second_key_of(column: str):
    return timing.second_key(F.col(column)).alias(column)


def _array_files(spark: SparkSession, rows: DataFrame, keys: list[str], order: list, item, most: int = 1_000) -> str:
    """Rows as files of one JSON array each, of at most ``most`` items, however many a key has."""
    placed = positions_by_range(rows, keys, order, "place").withColumn("chunk", F.expr(f"place div {most}"))
    arrays_of = placed.groupBy(*keys, "chunk").agg(F.to_json(F.collect_list(item)).alias("value"))
    path = fresh_path(spark, "arrays")
    arrays_of.write.partitionBy(*keys, "chunk").text(path)
    return path + "/*" * (len(keys) + 1)


def mention_files(spark: SparkSession, sf: str) -> DataFrame:
    """Mention counts as JSON arrays of a country, and read again."""
    rows = fx.mentions(spark, sf).withColumn("countrycode", F.col("code"))
    return readers.read_mentions(spark, _array_files(
        spark, rows, ["code"], [F.col("domain").asc()], F.struct("domain", "countrycode", "cnt")))


def authority_files(spark: SparkSession, sf: str) -> DataFrame:
    """Authority records as JSON arrays of some hundred, and read again."""
    path = _array_files(spark, fx.authority(spark, sf), [], [F.col("domain").asc(), F.col("domain_auth").asc()],
                        F.struct("domain", "domain_auth"), 200)
    return readers.read_authority(spark, path).select("domain", "domain_auth", "facebook_fol")


def mention_array(spark: SparkSession, sf: str) -> DataFrame:
    """All mention counts as one JSON array in one file, with braces and quotes in a name, read by several tasks."""
    rows = fx.mentions(spark, sf).select(
        F.concat(F.lit('{"a":[}\\'), F.col("domain")).alias("domain"), F.col("code").alias("countrycode"), "cnt")
    path = fresh_path(spark, "array")
    fx.array_file(rows, path)
    found = readers.read_json_array(spark, path, schemas.MENTION_COUNT)
    return found.select(F.substring("domain", 9, 1 << 20).alias("domain"), F.col("countrycode").alias("code"), "cnt")


def rank_files(spark: SparkSession, sf: str) -> DataFrame:
    """Domain ranks as one folder of files per country, named by it, and read again."""
    path = fresh_path(spark, "ranks")
    writers.write_ranks(fx.ranks(fx.mentions(spark, sf)), path)
    return readers.read_ranks(spark, path)


def dimension_files(spark: SparkSession, sf: str) -> DataFrame:
    """Country codes and languages as CSV files, and read again."""
    path = fresh_path(spark, "dimensions")
    fx.codes(spark, sf).write.option("header", True).csv(f"{path}/codes")
    languages = fx.documents(spark, sf).select("lang").distinct()
    languages.write.option("header", True).csv(f"{path}/languages")
    return (readers.read_country_codes(spark, f"{path}/codes").select("name", "code")
            .unionByName(readers.read_languages(spark, f"{path}/languages").select(
                F.col("lang").alias("name"), F.lit("language").alias("code"))))


PAGE_FOLDERS = 256


def _pages_as_files(spark: SparkSession, pages: DataFrame) -> str:
    """(page_id, value) as one file for each page. A folder of pages is written by one task, so the driver puts folders in
    their place and not each page, and a task lists a whole folder.

    A store that is a shared folder of the machines is written by the tasks themselves: without its native library Hadoop
    starts several processes for each file, to set the rights of the file, of its sums and of their folder. A file gets its
    name when it is whole, so a task may run again. Other stores go through Spark's writer. The files are the same.
    """
    path = fresh_path(spark, "pages")
    dealt = pages.withColumn("folder", F.pmod(F.xxhash64("page_id"), F.lit(PAGE_FOLDERS))).repartition(PAGE_FOLDERS, "folder")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.makeQualified(folder).toUri().getScheme() != "file":
        dealt.write.partitionBy("folder", "page_id").text(path)
        return path + "/*"
    top = store.makeQualified(folder).toUri().getPath()

    def write(batches):
        own, at, out = f".{uuid.uuid4().hex}", None, None
        for batch in batches:
            for folder, page, value in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (folder, page) != at:
                    if out:
                        out.close()
                        os.replace(f"{into}/{own}", f"{into}/part-0.txt")
                    at, into = (folder, page), f"{top}/folder={folder}/page_id={page}"
                    os.makedirs(into, exist_ok=True)
                    out = open(f"{into}/{own}", "wb")  # noqa: SIM115
                out.write((value or b"") + b"\n")
        if out:
            out.close()
            os.replace(f"{into}/{own}", f"{into}/part-0.txt")
        yield from ()

    named = F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("page")
    rows = dealt.select("folder", named, F.col("value").cast("binary").alias("value")).sortWithinPartitions("folder", "page")
    rows.mapInArrow(write, "folder long").write.format("noop").mode("overwrite").save()
    return path + "/*"


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """The crawled pages as one file each, some of them JSON strings, read again and their outlets extracted."""
    quoted = F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    path = _pages_as_files(spark, fx.outlet_pages(spark, sf).select(
        "page_id", F.when(F.col("page_id") % 2 == 0, quoted).otherwise(F.col("text")).alias("value")))
    pages = readers.read_pages(spark, path, nested=True).withColumn(
        "page_id", F.regexp_extract("path", r"page_id=(\d+)", 1).cast("bigint"))
    return outlets.extract_outlets(pages, "text", ["page_id"]).withColumn("record", F.col("record").cast("bigint"))


def outlet_files(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as one file each, read piece by piece between the marks."""
    path = _pages_as_files(spark, fx.outlet_pages(spark, sf).withColumnRenamed("text", "value"))
    found = outlets.extract_from_pieces(readers.read_marked(spark, path, OUTLET_MARK, nested=True))
    page = F.regexp_extract("file", r"page_id=(\d+)", 1).cast("bigint")
    return found.withColumn("page_id", page).drop("file").withColumn("record", F.col("record").cast("bigint"))


def table_append(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and domains appended to declared tables, the counts twice, and all read again."""
    name, before = "loads_" + uuid.uuid4().hex, spark.catalog.currentDatabase()
    spark.sql(f"CREATE DATABASE {name} LOCATION '{fresh_path(spark, 'database')}'")
    spark.catalog.setCurrentDatabase(name)
    try:
        schemas.create_tables(spark)
        counts = fx.counts(spark, sf).withColumn("day", F.to_date("slot"))
        for _ in range(2):
            writers.append_new(counts, "sentiment_counts", ["target_country", "slot", "scope", "model"])
        writers.append(domains.unique_domains(fx.domain_info(spark, sf)), "domain_info", ["domain", "country_code"])
        listed = readers.list_tables(spark, name).select("tableName")
        rows = readers.read_table(spark, f"{name}.sentiment_counts").select(
            F.lit("counts").alias("kind"), "target_country", KEY(), "scope", "model", "negative", "neutral", "positive")
        known = readers.read_table(spark, f"{name}.domain_info")
    finally:
        spark.catalog.setCurrentDatabase(before)

    def named(df: DataFrame, kind: str, column: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(column).alias("target_country"))

    return (rows.unionByName(named(known, "domain", "domain"), allowMissingColumns=True)
            .unionByName(named(listed, "table", "tableName"), allowMissingColumns=True))


def staged_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Titles staged per country, slot and scope in payloads of three, and read again."""
    titles = fx.placed_scores(spark, sf).where(F.col("model") == LEXICON)
    path = fresh_path(spark, "staged")
    for scope, query in ((NATIONAL, "economy"), (INTERNATIONAL, "-economy")):
        writers.stage(titles.where(F.col("scope") == scope), path, F.lit(query), chunk=3)
    return readers.staged_titles(readers.read_staged(spark, path)).drop("pos")


def scored_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Nested rows as scored payloads, and read again: both halves, both models, all classes."""
    path = fresh_path(spark, "scored")
    writers.write_scored(fx.nested(spark, sf, chunk=3), path)
    rows, halves = readers.read_scored(spark, path), []
    for scope, half in ((NATIONAL, "nat"), (INTERNATIONAL, "inter")):
        zipped = F.arrays_zip(*[F.col(f"{c}_{half}").alias(c) for c in ("titles", "lexicon", "classes")])
        each = rows.select("target_country", "on_time", F.explode(zipped).alias("h"))
        halves.append(each.select(
            "target_country", hour_key(F.col("on_time")).alias("slot_key"), F.lit(scope).alias("scope"),
            *[F.col("h")["titles"][i].alias(n) for i, n in enumerate(("title", "domain", "source_country"))],
            *[F.col("h")["lexicon"][n].alias(f"lexicon_{n}") for n in ("neg", "neu", "pos", "compound")],
            *[F.col("h")["classes"][i].alias(f"classifier_{n}") for i, n in enumerate(("neg", "neu", "pos"))]))
    return halves[0].unionByName(halves[1])


def batch_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents exported for two days, one of them twice, and one day imported."""
    docs, path = fx.documents(spark, sf), fresh_path(spark, "batches")
    for day in ("2025-02-01", "2025-02-02", "2025-02-01"):
        writers.export_batch(docs, path, day)
    return readers.import_batch(spark, path, "2025-02-01").drop("batch_day")


def term_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of a country joined into one query, and split again."""
    joined = fx.table(spark, sf, "nation").select(
        "n_name", text.join_terms(F.col("n_name"), fx.HEADLINE_SUBJECTS).alias("joined"))
    return joined.select("n_name", "joined", F.posexplode(text.split_terms(F.col("joined"))).alias("place", "term"))


QUERIES = {f.__name__: f for f in (
    label_counts, label_counts_by_group, label_counts_sql, counts_by_country_slot, counts_by_country,
    counts_one_country, counts_unknown_code, counts_missing_model, avg_scores, headline_total,
    headline_count_since, nested_label_counts, nested_counts_by_country, rows_per_country, rows_per_country_day,
    headline_lengths, scores_per_headline, pair_models, second_model_slice, nested_roundtrip, softmax_scores,
    three_class_compound, net_score_series, net_score_total, region_scores, country_slot_map, response_rows,
    composite_parse, subject_match, scope_split, both_scope_rows, dedup_titles, cap_per_group, relevant_articles,
    relevance_counters, language_volume, translated_titles, slot_window, slot_series, time_keys, pending_slots,
    domain_mentions, domain_weight, domain_best_rank, domain_authority, domain_authority_missing,
    relevant_domains_national, relevant_domains_international, domains_for_country, heavy_domains,
    country_code_lookup, code_to_country, registered_codes, unique_domains, batch_names, try_casts, mask_handles,
    token_counts, lexicon_sum, lexicon_score, outlet_extract, stream_slot_counts, batch_slot_counts,
    label_counts_day_subject, nested_daily, response_by_country, translate_hook, classify_documents,
    stream_append_once, stream_dedup_titles, stream_closed_counts, backfill_counts, article_files, mention_files,
    authority_files, staged_roundtrip, scored_roundtrip, batch_roundtrip, term_lists,
    load_scored, stream_load, load_counters, rollup_deltas, translation_batches, translation_memory, classify_once,
    phrase_sentiment, pending_bucketed, stream_append_nulls, rank_files, dimension_files, page_files, table_append,
    mention_array, outlet_files)}
