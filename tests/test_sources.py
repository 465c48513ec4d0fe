"""Readers and writers over temporary folders, tables, and the stored-key rules."""

import json

import pytest
from pyspark.sql import functions as F

from newsmood import schemas
from newsmood.constants import NATIONAL
from newsmood.functions.timing import hour_key, second_key
from newsmood.operators import domains
from newsmood.operators.nested import to_nested
from newsmood.plans import reports
from newsmood.sources import readers, shared, writers
from workload import fixtures as fx


def test_articles(spark, tmp_path):
    lines = [
        json.dumps({"articles": [
            {"url": "u1", "title": "A", "seendate": "20250101T101500Z", "domain": "d", "language": "English",
             "sourcecountry": "India"},
            {"url": "u2", "title": "B", "seendate": "soon", "domain": "d", "language": "French",
             "sourcecountry": "France"}]}),
        "{}", "not json at all {", json.dumps({"articles": []})]
    (tmp_path / "a.json").write_text("\n".join(lines))
    rows = readers.read_articles(spark, str(tmp_path)).orderBy("url").collect()
    assert [(r.url, r.arrival, r.source_country) for r in rows] == [("u1", 0, "India"), ("u2", 1, "France")]
    assert str(rows[0].seen) == "2025-01-01 10:15:00" and rows[1].seen is None


def test_domain_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"domain": "a.no", "countrycode": "NO", "cnt": 7},
                                                 {"domain": "a.no", "countrycode": "US", "cnt": 2}]))
    ranks = tmp_path / "ranks"
    ranks.mkdir()
    (ranks / "ranked-domains-top-NO.csv").write_text("2,a.no\n3,b.no\n")
    (ranks / "ranked-domains-top-US.csv").write_text("9,a.no,extra\n")
    (tmp_path / "auth.json").write_text(json.dumps([{"domain": "a.no", "domain_auth": "88"},
                                                    {"domain": "zzz", "domain_auth": "70"}]))
    mentions = readers.read_mentions(spark, str(tmp_path / "m.json"))
    assert {tuple(r) for r in mentions.collect()} == {("a.no", "NO", 7), ("a.no", "US", 2)}
    ranked = readers.read_ranks(spark, str(ranks))
    assert {tuple(r) for r in ranked.collect()} == {("a.no", "NO", 2.0), ("b.no", "NO", 3.0), ("a.no", "US", 9.0)}
    authority = readers.read_authority(spark, str(tmp_path / "auth.json"))
    info = domains.build_domain_info(mentions, ranked, authority).collect()
    assert [(r.domain, r.country_code, r.domain_auth) for r in info] == [("a.no", "NO", 88)]
    assert [r.domain for r in domains.unmatched_authority(mentions, authority).collect()] == ["zzz"]


def test_small_sources(spark, tmp_path):
    (tmp_path / "lang.csv").write_text("lang\nCZECH\nGREEK\n")
    assert [r.lang for r in readers.read_languages(spark, str(tmp_path / "lang.csv")).collect()] == ["CZECH", "GREEK"]
    (tmp_path / "codes.csv").write_text("name,code\nChad,XX\nTogo,TG\nChad,TD\n")
    assert {tuple(r) for r in readers.read_country_codes(spark, str(tmp_path / "codes.csv")).collect()} == {
        ("Chad", "TD"), ("Togo", "TG")}
    (tmp_path / "lex.txt").write_text("good\t1.9\t0.9\t[2, 1]\n:(\t-1.9\t1.1\t[]\n")
    assert {tuple(r) for r in readers.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()} == {("good", 1.9), (":(", -1.9)}
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "a.txt").write_text("one\ntwo \"x\"")
    (pages / "b.json").write_text(json.dumps("Media Outlet\nq \"x\""))
    assert {r.text for r in readers.read_pages(spark, str(pages)).collect()} == {"one\ntwo \"x\"", "Media Outlet\nq \"x\""}


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:postgresql://h/db", "global_info", user="u", password="p")
    assert plain["dbtable"] == "global_info" and "numPartitions" not in plain
    split = readers.jdbc_options("jdbc:postgresql://h/db", "t", column="id", lower=0, upper=100, partitions=8)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "0", "100", "8")
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:postgresql://h/db", "t", column="id")


def test_tables_append_once(spark, sf):
    schemas.create_tables(spark)
    names = {r.tableName for r in readers.list_tables(spark).collect()}
    assert set(schemas.TABLES) <= names
    counts = fx.counts(spark, sf).withColumn("day", F.to_date("slot"))
    keys = ["target_country", "slot", "scope", "model"]
    before = spark.table("sentiment_counts").count()
    for _ in range(2):
        writers.append_new(counts, "sentiment_counts", keys)
    stored = readers.read_table(spark, "sentiment_counts", F.col("day") == F.lit("2025-01-01").cast("date"))
    assert before == 0 and spark.table("sentiment_counts").count() == counts.count() and stored.count() > 0
    assert [f.dataType for f in stored.schema] == [f.dataType for f in schemas.SENTIMENT_COUNTS]
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    nested = to_nested(fx.placed_scores(spark, sf)).withColumns(
        {"on_time": F.col("slot"), "latest_processed": F.current_timestamp(), "day": F.to_date("slot")}).drop("slot")
    writers.append(nested, "global_info_hourly")
    assert spark.table("global_info_hourly").count() == nested.count()
    writers.append(domains.unique_domains(fx.domain_info(spark, sf)), "domain_info",
                   ["domain", "country_code", "country_mentions", "domain_weight", "change_date", "domain_auth"])
    assert spark.table("domain_info").select("domain").distinct().count() == spark.table("domain_info").count() > 0
    with pytest.raises(ValueError):
        writers.append(counts.withColumn("other", F.lit(1)), "sentiment_counts")


def test_only_new_with_and_without_salt(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "new") for i in range(90)], "id int, k string")
    stored = spark.createDataFrame([("hot",), ("hot",)], "k string")
    for by in (None, ["id"]):
        assert {r.k for r in writers.only_new(df, stored, ["k"], by).collect()} == {"new"}


def test_rows_with_null_keys_are_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, None), (None, "t", "2025-01-01"), (None, None, None)],
                                 "country string, title string, d string").select(
        "country", "title", F.col("d").cast("date").alias("day"))
    path = str(tmp_path / "table")
    for _ in range(2):
        writers.append_missing(rows, path, ["country", "title"])
    assert spark.read.schema(rows.schema).parquet(path).count() == 3
    for by in (None, ["title"]):
        assert writers.only_new(rows, rows.limit(0), ["country"], by).count() == (2 if by is None else 3)
        assert writers.only_new(rows, rows, ["country"], by).count() == 0


def test_staging(spark, sf, tmp_path):
    titles = fx.placed_scores(spark, sf).where(F.col("model") == "lexicon").where(F.col("scope") == NATIONAL)
    path = str(tmp_path / "staged")
    writers.stage(titles, path, F.lit("economy"), chunk=2)
    one = titles.select("target_country", second_key(F.col("slot")).alias("k")).first()
    got = readers.staged_titles(readers.read_staged(spark, path, one.target_country, one.k))
    expected = titles.where((F.col("target_country") == one.target_country) & (second_key(F.col("slot")) == one.k))
    assert sorted((r.title, r.domain, r.source_country) for r in got.collect()) == sorted(
        (r.title, r.domain, r.source_country) for r in expected.collect())
    with pytest.raises(FileNotFoundError):
        readers.read_staged(spark, path, "Atlantis", one.k)


def test_scored_payloads(spark, sf, tmp_path):
    nested = to_nested(fx.placed_scores(spark, sf))
    writers.write_scored(nested, str(tmp_path / "scored"))
    back = readers.read_scored(spark, str(tmp_path / "scored"))
    assert back.count() == nested.count()
    total = back.select(F.sum(F.size("lexicon_nat")).alias("l"), F.sum(F.size("classes_inter")).alias("c")).first()
    assert total.l == nested.select(F.sum(F.size("headline_national"))).first()[0]
    assert total.c == nested.select(F.sum(F.size("headline_inter"))).first()[0]
    a = back.select("target_country", hour_key(F.col("on_time")).alias("k"), "lexicon_nat.compound").orderBy("target_country", "k").collect()
    b = nested.select("target_country", hour_key(F.col("slot")).alias("k"),
                      F.col("sentiment_national")[0]["compound"].alias("compound")).orderBy("target_country", "k").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_batches_and_responses(spark, sf, tmp_path):
    root = str(tmp_path / "batches")
    df = spark.range(10)
    writers.export_batch(df, root, "2025-02-01")
    writers.export_batch(df, root, "2025-02-02")
    writers.export_batch(df.where("id < 3"), root, "2025-02-02")
    assert readers.import_batch(spark, root, "2025-02-01").count() == 10
    assert readers.import_batch(spark, root, "2025-02-02").count() == 3
    writers.write_partitioned(df.withColumn("day", F.lit("2025-01-01").cast("date")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 10
    responses = reports.as_response(reports.counts_by_slot(fx.counts(spark, sf)), fx.codes(spark, sf))
    writers.write_responses(responses, str(tmp_path / "r"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert len(lines) == responses.count() and all(len(v) == 7 for v in lines)


def test_shared_folder_is_the_sessions(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = shared.materialise(spark.range(5), "five")
    assert df.count() == 5 and shared.shared_dir(spark) in df.inputFiles()[0]


def test_release_deletes_what_was_written(spark):
    import os

    path = shared.materialise(spark.range(5), "gone").inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    assert shared.release(spark) >= 1 and not os.path.exists(path) and shared.release(spark) == 0


def test_large_mention_counts(spark):
    mentions = spark.createDataFrame([("a", "US", 3_000_000_000)], "domain string, code string, cnt long")
    assert domains.collect_mentions(mentions).first().country_mentions[0]["count"] == 3_000_000_000
