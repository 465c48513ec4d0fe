"""Operators against brute force over small fixtures, hot keys included."""

import datetime
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsmood.constants import CLASSIFIER, INTERNATIONAL, LEXICON, NATIONAL
from newsmood.functions.timing import ntz
from newsmood.operators import articles as art
from newsmood.operators import domains, labels, models, nested, outlets, skew
from newsmood.operators.lexicon import lexicon_score
from newsmood.plans import ingest, reports

SLOT = "2025-01-01 00:00:00"


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows and more have one key, and a third one title."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}"
        title = "copy" if rng.random() < 0.35 else f"t{rng.randrange(300)}"
        rows.append((i, key, title, rng.randrange(1000)))
    df = spark.createDataFrame(rows, "id long, key string, title string, score int").repartition(6)
    return rows, df


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_is_a_plain_join(spark, hot, how):
    _, df = hot
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("nowhere", 4)], "key string, v int")
    spread = skew.spread_join(df, small, ["key"], how, by=["id"])
    plain = df.join(small, ["key"], how)
    assert spread.columns == plain.columns
    assert Counter(spread.collect()) == Counter(plain.collect())


def test_spread_join_splits_the_hot_key(hot):
    _, df = hot
    salts = df.where("key = 'hot'").select(skew.salt(["id"], 16).alias("s")).groupBy("s").count().collect()
    assert len(salts) == 16


def test_first_per_group(hot):
    rows, df = hot
    expected = {}
    for i, key, title, _ in sorted(rows):
        expected.setdefault((key, title), i)
    got = {(r.key, r.title): r.id for r in art.dedup_titles(df, ["key"], [F.col("id")]).collect()}
    assert got == expected
    again = art.dedup_titles(art.dedup_titles(df, ["key"], [F.col("id")]), ["key"], [F.col("id")])
    assert again.count() == len(expected)


def test_first_per_group_is_cut_down_before_the_shuffle(hot):
    _, df = hot
    plan = art.dedup_titles(df, ["key"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1) > plan.index("Exchange hashpartitioning(key")


@pytest.mark.parametrize("n", [1, 7, 250])
def test_top_n_per_group(hot, n):
    rows, df = hot
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((-r[3], r[0]))
    expected = {(k, i) for k, v in groups.items() for _, i in sorted(v)[:n]}
    got = art.cap_per_group(df, ["key"], [F.col("score").desc(), F.col("id")], by=["id"], n=n)
    assert {(r.key, r.id) for r in got.collect()} == expected and got.count() == len(expected)


@pytest.mark.parametrize("width", [1, 64, 10_000])
def test_positions(hot, width):
    rows, df = hot
    seen, expected = Counter(), {}
    for i, key, _, _ in sorted(rows):
        expected[i] = seen[key]
        seen[key] += 1
    got = skew.positions(df, ["key"], [F.col("id")], F.floor(F.col("id") / width)).collect()
    assert {r.id: r.pos for r in got} == expected


def _articles(spark):
    rows = [
        (1, "India economy up", "a.in", "India", "English"), (2, "India economy up", "b.us", "US", "English"),
        (3, "Niger and Nigeria trade", "c.ng", "Nigeria", "French"), (4, "nothing here", "d.xx", "India", "English"),
        (5, "India trade", "e.xx", "India", "Chinese"), (6, "INDIA weather", "a.in", "India", "English"),
    ]
    return spark.createDataFrame(rows, "id int, title string, domain string, source_country string, language string")


@pytest.fixture(params=[1_000, 0])
def inline_terms(request, monkeypatch):
    """Terms matched within the row, and by a join."""
    monkeypatch.setattr(art, "INLINE_TERMS", request.param)


def test_scope_pairs(spark, inline_terms):
    terms = {"India": "India", "Niger": "Niger", "Nigeria": "Nigeria"}
    got = {(r.id, r.target_country, r.scope) for r in
           art.scope_pairs(_articles(spark), terms, ["Economy", "Trade"], by=["id"]).collect()}
    assert got == {(1, "India", NATIONAL), (2, "India", INTERNATIONAL), (3, "Niger", INTERNATIONAL),
                   (3, "Nigeria", NATIONAL), (5, "India", NATIONAL)}
    unlimited = art.scope_pairs(_articles(spark), terms, None, by=["id"])
    assert (6, "India") in {(r.id, r.target_country) for r in unlimited.collect()}


def test_every_word_of_a_term_is_needed(spark, inline_terms):
    df = _articles(spark).where("id = 3")
    pairs = art.scope_pairs(df, {"X": "niger trade", "Y": "niger economy"}, None, by=["id"])
    assert [r.target_country for r in pairs.collect()] == ["X"]


def test_terms_are_whole_words(spark, inline_terms):
    df = spark.createDataFrame(
        [(1, "Romania woman economy", "x"), (2, "Nigeria trade", "x"), (3, "Somalia-Mali energy", "x"),
         (4, "OMAN: trade, economy", "x"), (5, None, "x"), (6, "", "x")], "id int, title string, source_country string")
    terms = {c: c for c in ("Oman", "Romania", "Niger", "Nigeria", "Mali", "Somalia")}
    got = art.scope_pairs(df, terms, ["Economy", "Trade", "Energy"], by=["id"]).collect()
    assert {(r.id, r.target_country, tuple(r.subjects)) for r in got} == {
        (1, "Romania", ("Economy",)), (2, "Nigeria", ("Trade",)), (3, "Somalia", ("Energy",)), (3, "Mali", ("Energy",)),
        (4, "Oman", ("Economy", "Trade"))}


def test_rows_are_matched_one_by_one(spark, inline_terms):
    """The same article landed twice, two titles under one url, and null urls."""
    rows = [("u1", "India trade"), ("u1", "India trade"), ("u2", "Burkina economy"), ("u2", "Faso economy"),
            ("u3", "India"), ("u3", "economy"), (None, "India economy"), (None, "Burkina Faso trade")]
    df = spark.createDataFrame([(*r, "India") for r in rows], "url string, title string, source_country string")
    terms = {"India": "India", "Burkina Faso": "Burkina Faso"}
    got = art.scope_pairs(df, terms, ["Economy", "Trade"], by=["url"]).collect()
    assert sorted((r.url or "", r.title, r.target_country, tuple(r.subjects)) for r in got) == [
        ("", "Burkina Faso trade", "Burkina Faso", ("Trade",)), ("", "India economy", "India", ("Economy",)),
        ("u1", "India trade", "India", ("Trade",)), ("u1", "India trade", "India", ("Trade",))]


def test_flag_articles_keeps_repeated_articles(spark, inline_terms):
    seen = datetime.datetime(2024, 1, 1, 1)
    rows = [("u1", "India trade"), ("u1", "India trade"), ("u2", "India economy"), ("u2", "India energy"),
            (None, "India trade up")]
    df = spark.createDataFrame(
        [(*r, seen, "a.in", "English", "India") for r in rows],
        "url string, title string, seen timestamp_ntz, domain string, language string, source_country string")
    codes = spark.createDataFrame([("India", "IN")], "name string, code string")
    relevant = spark.createDataFrame([("a.in", ["IN"])], "domain string, codes array<string>")
    got = ingest.flag_articles(df, {"India": "India"}, codes, relevant, ["Trade", "Economy", "Energy"]).collect()
    assert sorted((r.url or "", r.title) for r in got) == [
        ("", "India trade up"), ("u1", "India trade"), ("u2", "India economy"), ("u2", "India energy")]


def test_any_number_of_terms(spark):
    df = spark.createDataFrame([(1, "w17 w4999", "x")], "id int, title string, source_country string")
    got = art.scope_pairs(df, {f"C{i}": f"w{i}" for i in range(5_000)}, None, by=["id"]).collect()
    assert {r.target_country for r in got} == {"C17", "C4999"}


def test_domain_info(spark):
    mentions = spark.createDataFrame(
        [("a", "US", 5), ("a", "IN", 9), ("a", "IN", 9), ("b", "US", 1)], "domain string, code string, cnt int")
    ranks = spark.createDataFrame(
        [("a", "US", 3.0), ("a", "IN", 3.0), ("a", "NO", 8.0), ("z", "US", 1.0)], "domain string, code string, rank double")
    auth = spark.createDataFrame([("a", "91"), ("q", "50"), ("b", "n/a")], "domain string, domain_auth string")
    info = {r.domain: r for r in domains.build_domain_info(mentions, ranks, auth).collect()}
    assert set(info) == {"a", "b"}
    assert [tuple(m) for m in info["a"].country_mentions] == [("IN", 9), ("US", 5)]
    assert info["a"].country_code == "IN" and info["a"].domain_auth == 91
    assert info["a"].domain_weight == pytest.approx(1 / (np.log(13) + 1) + 0.68)
    assert info["b"].domain_weight == 0.0 and info["b"].country_code is None and info["b"].domain_auth is None
    assert len(info["a"].change_date) == 14
    assert [r.domain for r in domains.unmatched_authority(mentions, auth).collect()] == ["q"]


def test_relevance_with_fallback(spark):
    info = spark.sql("""SELECT * FROM VALUES
        ('a', array(named_struct('country_code', 'IN', 'count', 10)), 0.0D),
        ('b', array(named_struct('country_code', 'US', 'count', 10), named_struct('country_code', 'IN', 'count', 1)), 0.0D),
        ('c', array(named_struct('country_code', 'US', 'count', 1)), 0.9D),
        ('d', array(named_struct('country_code', 'IN', 'count', 1)), 0.1D) AS t(domain, country_mentions, domain_weight)""")
    relevant = domains.relevant_domains(info, 5, 0.76)
    assert {r.domain: r.codes for r in relevant.collect()} == {"a": ["IN"], "b": ["US"], "c": ["US"]}
    for international, expected in ((False, {"a"}), (True, {"b", "c"})):
        assert {r.domain for r in domains.domains_for(info, "IN", international, 5, 0.76).collect()} == expected
    counts = domains.international_counts(relevant, spark.createDataFrame([("IN",), ("US",), ("NO",)], "code string"))
    assert {r.target_code: r.domains for r in counts.collect()} == {"IN": 2, "US": 1, "NO": 3}
    rows = spark.createDataFrame(
        [(1, "a", NATIONAL, "g1"), (2, "d", NATIONAL, "g1"), (3, "d", NATIONAL, "g2"), (4, "x", NATIONAL, "g2"),
         (5, "a", INTERNATIONAL, "g3"), (6, "b", INTERNATIONAL, "g3")],
        "id int, domain string, scope string, g string").withColumn("target_code", F.lit("IN"))
    flagged = art.with_relevance(rows, relevant, by=["id"])
    assert {r.id for r in flagged.where("relevant").collect()} == {1, 6}
    assert {r.id for r in art.keep_relevant(flagged, ["g"], by=["id"]).collect()} == {1, 3, 4, 6}
    assert {(r.g, r.kept, r.removed) for r in art.relevance_counters(flagged, ["g"]).collect()} == {
        ("g1", 1, 1), ("g2", 0, 2), ("g3", 1, 1)}


def test_complete_only_and_pending(spark):
    rows = spark.createDataFrame([(1, "A", NATIONAL), (2, "A", INTERNATIONAL), (3, "B", NATIONAL)],
                                 "id int, target_country string, scope string")
    assert [tuple(r) for r in art.scope_totals(rows, ["target_country"]).collect()] == [("A", 2)]
    assert {r.id for r in art.complete_only(rows, ["target_country"], by=["id"]).collect()} == {1, 2}
    grid = spark.createDataFrame([("A",), ("B",), ("C",)], "target_country string")
    assert {r.target_country for r in art.pending(grid, rows, ["target_country"]).collect()} == {"C"}


def test_translation_table_and_hook_agree(spark):
    df = _articles(spark)
    table = spark.createDataFrame([("French", "Niger and Nigeria trade", "NNT")],
                                  "language string, title string, title_en string")

    def translator(language, titles):
        return ["NNT" if language == "French" else None for _ in titles]

    by_table = art.translate_titles(df, table).select(df.columns).collect()
    by_hook = art.translate_titles(df, translator=translator).collect()
    assert sorted(by_table) == sorted(by_hook)
    assert {r.id: r.title for r in by_hook}[3] == "NNT" and 5 not in {r.id for r in by_hook}
    assert {(r.id, r.domain) for r in by_hook} == {(i, d) for i, d in [(1, "a.in"), (2, "b.us"), (3, "c.ng"), (4, "d.xx"), (6, "a.in")]}
    with pytest.raises(ValueError):
        art.translate_titles(df)


def test_language_volume(spark):
    got = {r.language: (r.titles, r.chars) for r in art.language_volume(_articles(spark)).collect()}
    assert got["chinese (simplified)"] == (1, 11) and got["english"][0] == 4


def _scored(spark, n=50):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        for scope in (NATIONAL, INTERNATIONAL):
            for model in (LEXICON, CLASSIFIER):
                if model == CLASSIFIER and i % 9 == 0:
                    continue
                neg, neu, pos = (round(rng.random(), 4) for _ in range(3))
                rows.append(("C%d" % (i % 2), scope, i // 2, f"t{i}", "d", "s", model, neg, neu, pos,
                             round(rng.uniform(-1, 1), 4)))
    return spark.createDataFrame(
        rows, "target_country string, scope string, pos long, title string, domain string, source_country string, "
              "model string, neg double, neu double, positive double, compound double").withColumn("slot", ntz(SLOT))


@pytest.mark.parametrize("chunk", [1_000, 7])
def test_nested_round_trip(spark, chunk):
    scored = _scored(spark)
    wide = nested.to_nested(scored, chunk=chunk)
    assert (wide.count() == 2) == (chunk == 1_000)
    back = nested.from_nested(wide)
    assert Counter(back.select(sorted(back.columns)).collect()) == Counter(scored.select(sorted(back.columns)).collect())
    six = labels.label_counts(scored, scope=NATIONAL).collect()[0].asDict()
    stored = wide.select(F.inline("senti_count_nat")).agg(F.sum("negative"), F.sum("neutral"), F.sum("positive")).collect()[0]
    assert sum(stored) == sum(six.values()) == scored.where(F.col("scope") == NATIONAL).count()
    total = nested.headline_total(wide).collect()[0].headline_amount
    lengths = nested.headline_lengths(wide, ["target_country"]).collect()
    assert {r.rows for r in reports.rows_per(wide, ["target_country"]).collect()} == {1}
    paired = nested.pair_models(wide, NATIONAL, ["target_country"]).select("target_country", "pos").collect()
    assert len(set(paired)) == len(paired) == 50
    assert total == sum(r.head_nat for r in lengths) == 50


def test_unnest_pads_shorter_arrays(spark):
    df = spark.sql("""SELECT array(named_struct('title', 'a', 'domain', 'd', 'source_country', 's'),
                                   named_struct('title', 'b', 'domain', 'd', 'source_country', 's')) AS headline_national,
                      array(array(named_struct('neg', 0D, 'neu', 0D, 'pos', 1D, 'compound', 0.5D))) AS sentiment_national,
                      0L AS first_pos""")
    rows = nested.unnest_scope(df, NATIONAL, []).orderBy("pos").collect()
    assert [r.lexicon and r.lexicon.compound for r in rows] == [0.5, None] and rows[0].classifier is None
    assert nested.scores_per_headline(df, NATIONAL, []).where("title = 'b'").collect()[0].classifier_polarity is None


def test_counts_sum_to_headlines(spark):
    scored = _scored(spark)
    counts = labels.tally_labels(scored, ["target_country", "slot", "scope", "model"])
    total = counts.agg(F.sum(F.col("negative") + F.col("neutral") + F.col("positive")).alias("n")).collect()[0].n
    assert total == scored.count()
    assert labels.with_label(scored).groupBy("label").count().agg(F.sum("count")).collect()[0][0] == total
    series = reports.net_score_series(counts, NATIONAL).collect()
    assert all(-1 <= r.net <= 1 for r in series) and [r.target_country for r in series] == ["C0", "C1"]
    by_slot = reports.counts_by_slot(counts, "C1").collect()
    assert len(by_slot) == 1 and reports.counts_by_slot(counts, "World").count() == 2
    assert reports.counts_by_slot(counts, since=ntz("2025-01-02")).count() == 0
    with pytest.raises(ValueError):
        reports.net_score_series(counts, "everywhere")


def test_counts_with_missing_cells(spark):
    counts = spark.createDataFrame(
        [("A", NATIONAL, LEXICON, 1, 2, 3), ("A", NATIONAL, LEXICON, None, None, None),
         ("A", INTERNATIONAL, LEXICON, 1, 1, 1)],
        "target_country string, scope string, model string, negative long, neutral long, positive long")
    strict = reports.counts_by_country(counts).collect()[0]
    loose = reports.counts_by_country(counts, "skip").collect()[0]
    assert tuple(strict.lexicon_nat) == (None, None, None) and tuple(loose.lexicon_nat) == (1, 2, 3)
    assert strict.classifier_nat is None and tuple(strict.lexicon_int) == (1, 1, 1)


def test_region_scores_and_net(spark):
    totals = spark.createDataFrame([("NO", 0.25), ("SE", None)], "country_code string, net double")
    regions = spark.createDataFrame([("NO_1",), ("NO_2",), ("SE_1",), ("DK_1",)], "region_name string")
    got = {r.region_name: r.sentiment for r in reports.region_scores(regions, totals).collect()}
    assert got == {"NO_1": 0.25, "NO_2": 0.25, "SE_1": None, "DK_1": -500.0}
    assert reports.region_scores(regions, totals, missing=None).where("region_name = 'DK_1'").collect()[0].sentiment is None


# Published example sentences of the model with the scores of its authors' word list.
LEXICON_ROWS = [("smart", 1.7), ("handsome", 2.2), ("funny", 1.9), ("good", 1.9), ("great", 3.1),
                ("uncompelling", -0.9), ("horrible", -2.5), ("kind", 2.4)]
SENTENCES = [
    ("VADER is smart, handsome, and funny.", 0.0, 0.254, 0.746, 0.8316),
    ("VADER is smart, handsome, and funny!", 0.0, 0.248, 0.752, 0.8439),
    ("VADER is very smart, handsome, and funny.", 0.0, 0.299, 0.701, 0.8545),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.0, 0.246, 0.754, 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.0, 0.233, 0.767, 0.9342),
    ("VADER is not smart, handsome, nor funny.", 0.646, 0.354, 0.0, -0.7424),
    ("The book was good.", 0.0, 0.508, 0.492, 0.4404),
    ("At least it isn't a horrible book.", 0.0, 0.637, 0.363, 0.431),
    ("The plot was good, but the characters are uncompelling and the dialog is not great.", 0.327, 0.579, 0.094, -0.7042),
    ("nothing known here", 0.0, 1.0, 0.0, 0.0), ("", 0.0, 0.0, 0.0, 0.0), ("a", 0.0, 0.0, 0.0, 0.0),
    # By hand: (1.9 + 0.293) * 1.5 = 3.2895 for "so" and "never so"; 1.9 * -0.74 = -1.406 for "least".
    ("never so good", 0.0, 0.318, 0.682, 0.6474), ("least good", 0.706, 0.294, 0.0, -0.3412),
    # "kind of" has no valence of its own and weakens: 1.9 - 0.293 = 1.607
    ("it was kind of late", 0.0, 1.0, 0.0, 0.0), ("it was kind of good", 0.0, 0.605, 0.395, 0.3832),
]


def test_lexicon_sentences(spark):
    lexicon = spark.createDataFrame(LEXICON_ROWS, "token string, valence double")
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SENTENCES)], "id int, text string")
    got = {r.id: (r.neg, r.neu, r.positive, r.compound) for r in lexicon_score(df, lexicon, "text", ["id"]).collect()}
    wrong = {SENTENCES[i][0]: (got[i], s[1:]) for i, s in enumerate(SENTENCES) if got[i] != s[1:]}
    assert not wrong


def test_idioms(spark):
    lexicon = spark.createDataFrame([("hand", 2.2), ("bomb", -2.2), ("mustard", 0.5)], "token string, valence double")
    df = spark.createDataFrame([(0, "this is really the bomb"), (1, "they lived hand to mouth here"), (2, "bomb"),
                                (3, "we all cut the mustard")], "id int, text string")
    idioms = {"the bomb": 3.0, "hand to mouth": -2.0, "cut the mustard": 2.0}
    got = {r.id: r.compound for r in lexicon_score(df, lexicon, "text", ["id"], idioms).collect()}
    expected = {0: 3.0, 1: 2.2, 2: -2.2, 3: 2.0}  # of the second, only two words come before: no phrase is looked for
    assert got == {i: pytest.approx(round(v / np.sqrt(v * v + 15), 4)) for i, v in expected.items()}


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_lexicon_tables_are_broadcast_by_their_size_or_joined_by_a_shuffle(spark, threshold):
    lexicon = spark.createDataFrame(LEXICON_ROWS, "token string, valence double")
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SENTENCES)], "id int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        scored = lexicon_score(df, lexicon, "text", ["id"], {"not a phrase here": 1.0, "no phrase": 2.0})
        plan = scored._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.compound for r in scored.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: s[4] for i, s in enumerate(SENTENCES)}
    if threshold != "-1":  # only the sums of texts are shuffled, no words
        assert plan.count("Exchange hashpartitioning(id") == 1 == plan.count("Exchange hashpartitioning")
        assert "SortMergeJoin" not in plan


def test_phrases_are_a_table_of_any_size(spark):
    lexicon = spark.createDataFrame(LEXICON_ROWS, "token string, valence double")
    words = "one two three four five six seven eight nine ten".split()
    phrases = spark.range(100_000).select(
        F.concat(F.lit("p"), "id", F.lit(" q"), F.col("id") % 10).alias("phrase"), (F.col("id") % 7).cast("double").alias("value"))
    more = spark.createDataFrame([("three good", 0.7), ("two three good", -1.2), ("good four", 2.0), ("good four five", -2.5)],
                                 "phrase string, value double")
    df = spark.createDataFrame([(0, "one two three good"), (1, "zero one three good four"), (2, "one zero three good four five"),
                                (3, "one one three good"), (4, " ".join(words))], "id int, text string")
    scored = lexicon_score(df, lexicon, "text", ["id"], phrases.unionByName(more))
    plan = scored._jdf.queryExecution().toString()
    assert "p99999" not in plan and len(plan) < 200_000
    got = {r.id: r.compound for r in scored.collect()}
    expected = {0: 0.7, 1: 2.0, 2: -2.5, 3: 0.7, 4: 0.0}  # the shorter phrase that ends here comes before the longer
    assert got == {i: pytest.approx(round(v / np.sqrt(v * v + 15), 4)) for i, v in expected.items()}


def test_daily_form(spark):
    scored = _scored(spark).withColumn("subjects", F.expr(
        "IF(pos % 2 = 0, array('Economy', 'Trade'), array('Trade'))"))
    daily = nested.to_daily(scored, chunk=7)
    rows = nested.unnest(daily, ["target_country", "on_day", "on_subject"]).collect()
    trade = [r for r in rows if r.on_subject == "Trade" and r.scope == NATIONAL and r.target_country == "C0"]
    assert sorted(r.pos for r in trade) == list(range(25)) and set(trade[0].headline.asDict()) == {"title", "domain"}
    assert sum(r.on_subject == "Economy" for r in rows) == sum(r["count"] for r in scored.where(
        "array_contains(subjects, 'Economy') AND model = 'lexicon'").groupBy().count().collect())
    six = labels.label_counts(scored, subject="Economy").collect()[0].asDict()
    assert sum(six.values()) == scored.where("array_contains(subjects, 'Economy')").count()


def test_classifier_hook(spark):
    def make():
        def score(titles):
            return np.array([[0.0, 1.0, float(len(t))] for t in titles])
        return score

    df = spark.createDataFrame([("ab",), ("abcdef",)], "title string")
    got = {r.title: r for r in models.classify(df, make).collect()}
    e = np.exp([0.0, 1.0, 2.0])
    share = [round(float(v), 4) for v in e / e.sum()]
    assert [got["ab"].neg, got["ab"].neu, got["ab"].positive] == share
    assert got["ab"].compound == pytest.approx((share[2] - share[0]) / (share[1] + 1)) and got["ab"].label == "positive"


def test_outlets(spark):
    page = ("intro Media Outlet one.cn Facebook Followers 105MTwitter Twitter Followers 2KInstagram Instagram Followers 9K "
            "Frequency 2 posts/year Domain Authority 91 " + "x" * 60
            + " Media Outlet\ntwo.cn Domain Authority 59 " + "y" * 150
            + " Media Outlet nytimes.com Domain Authority 95 " + "y" * 150
            + " Media Outlet three.cn Domain Authority none " + "y" * 150
            + " Media Outlet Contact " + "y" * 150 + " Media Outlet late.cn Domain Authority 99 ")
    df = spark.createDataFrame([(1, page), (2, "no marks"), (3, "Media Outlet solo.cn Domain Authority 100 ")],
                               "id int, text string")
    rows = [tuple(r) for r in outlets.extract_outlets(df, "text", ["id"]).collect()]
    assert rows == [(3, 0, "solo.cn", "", "", "", "", "100"),
                    (1, 0, "one.cn", "105M", "2K", "9K", "2posts/year", "91")]
