"""Streams against the same rows in batch, re-runs, deduplication over batches, backfill, and the whole load."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmood.constants import CLASSIFIER, INTERNATIONAL, LEXICON, NATIONAL
from newsmood.functions.timing import slot_start, to_instant
from newsmood.operators import domains
from newsmood.plans import ingest
from newsmood.streaming import slots as stream
from workload import fixtures as fx
from workload.queries import batch_slot_counts, stream_slot_counts


def test_stream_is_batch(spark, sf):
    a, b = stream_slot_counts(spark, sf), batch_slot_counts(spark, sf)
    assert Counter(a.collect()) == Counter(b.collect())


def test_closed_slots_are_final(spark, sf, tmp_path):
    schema = fx.table(spark, sf, "events").schema
    rows = stream.with_watermark(fx.labelled_events(stream.read_stream(spark, sf, schema, "events.parquet")), "ts", "1 hour")
    out = str(tmp_path / "closed")
    stream.start_closed_counts(stream.slot_counts(rows, ["event_type"]), out, str(tmp_path / "cp")).awaitTermination()
    closed = spark.read.parquet(out).select(F.date_format("slot", "yyyy-MM-dd-HH").alias("slot_key"), "event_type",
                                            "negative", "neutral", "positive").collect()
    everything = {tuple(r) for r in batch_slot_counts(spark, sf).collect()}
    assert {tuple(r) for r in closed} <= everything and len(closed) == len({tuple(r)[:2] for r in closed})


def test_positions_of_one_minute(spark):
    from newsmood.plans.ingest import rank_titles
    df = spark.range(500).select(
        F.lit("X").alias("target_country"), F.lit(NATIONAL).alias("scope"), F.lit("2025-01-01").cast("timestamp_ntz").alias("slot"),
        F.lit("2025-01-01 00:00:30").cast("timestamp_ntz").alias("seen"), F.concat(F.lit("u"), "id").alias("url"),
        F.lit("t").alias("title"), F.lit("d").alias("domain"), F.lit("s").alias("source_country"),
        F.array().cast("array<string>").alias("subjects"))
    assert sorted(r.pos for r in rank_titles(df).collect()) == list(range(500))


def _landed(spark, tmp_path, sf):
    events = fx.labelled_events(fx.table(spark, sf, "events")).withColumn("day", F.to_date("ts"))
    path = str(tmp_path / "landed")
    events.repartition(4).write.parquet(path)
    return events, path


def test_append_again_adds_nothing(spark, sf, tmp_path):
    events, landed = _landed(spark, tmp_path, sf)
    out = str(tmp_path / "out")
    for run in range(2):  # the second run has lost its checkpoint and sees every file again
        source = stream.read_stream(spark, landed, events.schema, files_per_trigger=1)
        stream.start_append(source, out, str(tmp_path / f"cp{run}"), ["event_id"]).awaitTermination()
    stored = spark.read.schema(events.schema).parquet(out)
    assert stored.count() == events.count() == stored.select("event_id").distinct().count()


def test_a_slot_in_two_batches_and_a_rerun_keeps_every_row_once(spark, tmp_path):
    """Rows are told apart by title; the slot is the same in both micro-batches, and both are run again."""
    keys, path, out = ["target_country", "slot", "scope", "title"], str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame(
        [("C", NATIONAL, "first", "2025-01-01"), ("C", NATIONAL, "second", "2025-01-01"),
         ("C", NATIONAL, "first", "2025-01-01"), ("D", NATIONAL, "first", "2025-01-02")],
        "target_country string, scope string, title string, t string").select(
        "target_country", "scope", "title", F.col("t").cast("timestamp_ntz").alias("slot"), F.col("t").cast("date").alias("day"))
    for title in ("first", "second"):
        rows.where(F.col("title") == title).coalesce(1).write.mode("append").parquet(path)
    for run in range(2):
        source = stream.read_stream(spark, path, rows.schema, files_per_trigger=1)
        stream.start_append(source, out, str(tmp_path / f"cp{run}"), keys).awaitTermination()
    got = sorted((r.target_country, r.title) for r in spark.read.schema(rows.schema).parquet(out).collect())
    assert got == [("C", "first"), ("C", "second"), ("D", "first")]


def test_counts_keep_two_versions_and_late_rows_are_counted(spark, tmp_path):
    import os

    rows = spark.createDataFrame([("A", f"2025-01-0{d} 00:30:00") for d in (1, 3, 5, 2)], "label string, t string").select(
        "label", F.col("t").cast("timestamp_ntz").alias("ts"))
    path = str(tmp_path / "in")
    for d in ("01", "03", "05", "02"):  # the last file is days late
        rows.where(F.date_format("ts", "dd") == d).coalesce(1).write.mode("append").parquet(path)
    source = stream.with_watermark(stream.read_stream(spark, path, rows.schema, files_per_trigger=1), "ts", "1 hour")
    counts = stream.slot_counts(source, [])
    query = stream.start_counts(counts, str(tmp_path / "t"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sorted(x for x in os.listdir(tmp_path / "t") if x.startswith("v=")) == ["v=0", "v=1"]
    assert stream.latest(spark, str(tmp_path / "t"), counts.schema).count() == 4
    closed = stream.start_closed_counts(counts, str(tmp_path / "c"), str(tmp_path / "cp2"))
    closed.awaitTermination()
    assert stream.late_rows(closed) == 1


def test_backfill_is_the_stream(spark, sf, tmp_path):
    events, _ = _landed(spark, tmp_path, sf)
    out = str(tmp_path / "filled")
    days = [r.d for r in events.select(F.date_trunc("day", "ts").cast("date").alias("d")).distinct().orderBy("d").limit(2).collect()]
    slots = spark.createDataFrame([(f"{days[0]} 04:00:00",), (f"{days[0]} 08:00:00",)], "s string").select(
        F.col("s").cast("timestamp_ntz").alias("slot"))
    for _ in range(2):
        stream.append_missing(stream.backfill(events, slots, "ts").drop("slot"), out, ["event_id"])
    stored = spark.read.schema(events.schema).parquet(out)
    wanted = events.where(slot_start(F.col("ts")).cast("string").isin(f"{days[0]} 04:00:00", f"{days[0]} 08:00:00"))
    assert Counter(r.event_id for r in stored.collect()) == Counter(r.event_id for r in wanted.collect())


def test_dedup_over_batches(spark, tmp_path):
    rows = spark.createDataFrame(
        [("A", "2025-01-01 00:10:00"), ("A", "2025-01-01 01:00:00"), ("B", "2025-01-01 02:00:00"),
         ("A", "2025-01-01 03:00:00")], "title string, t string").select("title", F.col("t").cast("timestamp_ntz").alias("ts"))
    path = str(tmp_path / "in")
    rows.repartition(4).write.parquet(path)
    source = stream.with_watermark(stream.read_stream(spark, path, rows.schema, files_per_trigger=1), "ts", "4 hours")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    query = (stream.dedup_stream(source, ["title"]).select("title").writeStream.outputMode("append")
             .option("checkpointLocation", cp).trigger(availableNow=True).format("parquet").start(out))
    query.awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(out).collect()) == ["A", "B"]


ARTICLES = [
    ("u1", "India economy good", "2025-01-01 00:05:00", "a.in", "English", "India"),
    ("u2", "India economy good", "2025-01-01 00:06:00", "a.in", "English", "India"),
    ("u3", "India trade horrible", "2025-01-01 01:00:00", "b.us", "English", "US"),
    ("u4", "India economy unknown site", "2025-01-01 01:10:00", "x.xx", "English", "India"),
    ("u5", "India handel", "2025-01-01 02:00:00", "b.us", "German", "US"),
    ("u6", "India trade fehlt", "2025-01-01 02:30:00", "b.us", "German", "US"),
    ("u7", "Chad economy", "2025-01-01 02:00:00", "c.td", "English", "Chad"),
    ("u8", "India economy", "2025-01-01 05:00:00", "x.xx", "English", "India"),
    ("u9", "India trade good", "2025-01-01 05:30:00", "y.yy", "English", "US"),
]


def _load(spark, **kw):
    articles = spark.createDataFrame(ARTICLES, "url string, title string, t string, domain string, language string, source_country string") \
        .withColumn("seen", F.col("t").cast("timestamp_ntz")).drop("t")
    codes = spark.createDataFrame([("India", "IN"), ("Chad", "TD")], "name string, code string")
    info = spark.sql("""SELECT * FROM VALUES
        ('a.in', array(named_struct('country_code', 'IN', 'count', 10)), 0.0D),
        ('b.us', array(named_struct('country_code', 'US', 'count', 10)), 0.0D) AS t(domain, country_mentions, domain_weight)""")
    translations = spark.createDataFrame([("German", "India handel", "India trade great")],
                                         "language string, title string, title_en string")
    lexicon = spark.createDataFrame([("good", 1.9), ("horrible", -2.5), ("great", 3.1)], "token string, valence double")
    return ingest.load(articles, {"India": "India", "Chad": "Chad"}, codes,
                       domains.relevant_domains(info, 5, 0.76), lexicon=lexicon, translations=translations,
                       subjects=["Economy", "Trade", "Handel"], **kw)


def test_load(spark):
    fact = _load(spark)
    got = {(str(r.slot), r.scope, r.pos, r.title): r.compound for r in fact.collect()}
    # Chad has one scope only; the repeated title, the unknown site beside a known one and the failed translation are gone;
    # the second slot knows no site at all and keeps everything.
    assert set(got) == {
        ("2025-01-01 00:00:00", NATIONAL, 0, "India economy good"),
        ("2025-01-01 00:00:00", INTERNATIONAL, 0, "India trade horrible"),
        ("2025-01-01 00:00:00", INTERNATIONAL, 1, "India trade great"),
        ("2025-01-01 04:00:00", NATIONAL, 0, "India economy"),
        ("2025-01-01 04:00:00", INTERNATIONAL, 0, "India trade good")}
    assert got[("2025-01-01 00:00:00", NATIONAL, 0, "India economy good")] == pytest.approx(0.4404)
    counts = ingest.count_labels(fact).collect()
    assert {(r.scope, str(r.slot)[11:13], r.negative, r.neutral, r.positive) for r in counts} == {
        (NATIONAL, "00", 0, 0, 1), (INTERNATIONAL, "00", 1, 0, 1), (NATIONAL, "04", 0, 1, 0), (INTERNATIONAL, "04", 0, 0, 1)}


def test_load_keeps_every_article_of_a_group(spark):
    rows = [(f"u{i}", f"India economy story {i}", "2025-01-01 00:05:00", "a.in", "English", "India") for i in range(600)]
    rows += [("x", "India economy abroad", "2025-01-01 00:06:00", "b.us", "English", "US")]
    ARTICLES_BEFORE = list(ARTICLES)
    try:
        ARTICLES[:] = rows
        fact = _load(spark)
        assert fact.where(F.col("scope") == NATIONAL).select("title").distinct().count() == 600
        assert fact.first().subjects == ["Economy"]
        by_subject = ingest.count_labels(fact, by_subject=True).where(F.col("scope") == NATIONAL).collect()
        assert [(r.subject, r.negative + r.neutral + r.positive) for r in by_subject] == [("Economy", 600)]
    finally:
        ARTICLES[:] = ARTICLES_BEFORE


def test_load_with_both_models(spark):
    def make():
        return lambda titles: np.array([[0.0, 0.0, 3.0]] * len(titles))

    fact = _load(spark, make_scorer=make)
    by_model = {r["model"]: r["count"] for r in fact.groupBy("model").count().collect()}
    assert by_model == {LEXICON: 5, CLASSIFIER: 5}
    assert ingest.count_labels(fact).where(F.col("model") == CLASSIFIER).agg(F.sum("positive")).first()[0] == 5


def _recorded(monkeypatch):
    """The tables the load stores, by label."""
    stored, store = {}, ingest.materialise
    monkeypatch.setattr(ingest, "materialise", lambda df, label: stored.setdefault(label, []).append(store(df, label)) or stored[label][-1])
    return stored


def test_a_title_travels_once(spark, monkeypatch):
    """Titles that name three countries, landed twice and by two sites: stored once, and no table of pairs holds them."""
    stored = _recorded(monkeypatch)
    names = ["Chad", "India", "Mali"]
    rows = [(f"u{i}{site}", f"Chad India Mali trade {i % 20} good", f"2025-01-01 00:{i % 60:02d}:00", "a.in", "English", site)
            for i in range(40) for site in ("Chad", "India", "Mali")] * 2
    articles = spark.createDataFrame(
        rows, "url string, title string, t string, domain string, language string, source_country string") \
        .withColumn("seen", F.col("t").cast("timestamp_ntz")).drop("t")
    fact = ingest.load(articles, {n: n for n in names}, spark.createDataFrame([(n, n) for n in names], "name string, code string"),
                       spark.createDataFrame([("a.in", names)], "domain string, codes array<string>"),
                       lexicon=spark.createDataFrame([("good", 1.9)], "token string, valence double"), subjects=["Trade"])
    got = fact.collect()
    assert len(got) == 20 * 3 * 2  # every title for every country, from there and from abroad
    assert {(r.title, round(r.compound, 4)) for r in got} == {(f"Chad India Mali trade {i} good", 0.4404) for i in range(20)}
    texts = [t.where(F.col("title").isNotNull()).count() for tables in stored.values() for t in tables if "title" in t.columns]
    assert max(texts) == 20 * 2  # of the first country only, from there and from abroad
    assert all("title" not in t.columns for label in ("flagged", "titles", "ranked") for t in stored[label])


def test_load_with_a_translator(spark):
    """A translator is asked for each title of a language once, also for articles without a language; failures drop out."""
    asked = spark.sparkContext.accumulator(0)

    def translate(language, titles):
        asked.add(len(titles))
        return [None if "fehlt" in t else f"{t} great" for t in titles]

    rows = [(f"u{i}", title, "2025-01-01 00:05:00", "b.us", language, source) for i, (title, language, source) in enumerate([
        ("India handel", "German", "US"), ("India handel", "German", "India"), ("India handel fehlt", "German", "US"),
        ("India handel eins", None, "US"), ("India economy", "English", "India")])]
    articles = spark.createDataFrame(
        rows, "url string, title string, t string, domain string, language string, source_country string") \
        .withColumn("seen", F.col("t").cast("timestamp_ntz")).drop("t")
    fact = ingest.load(articles, {"India": "India"}, spark.createDataFrame([("India", "IN")], "name string, code string"),
                       spark.createDataFrame([("b.us", ["IN", "US"])], "domain string, codes array<string>"),
                       lexicon=spark.createDataFrame([("great", 3.1)], "token string, valence double"),
                       translator=translate, subjects=["Economy", "Handel"])
    assert sorted((r.scope, r.title) for r in fact.collect()) == [
        (INTERNATIONAL, "India handel eins great"), (INTERNATIONAL, "India handel great"),
        (NATIONAL, "India economy"), (NATIONAL, "India handel great")]
    assert asked.value == 3
