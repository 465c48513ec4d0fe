"""Column functions on hand-computed rows: edges, NULL, empty arrays, zero denominators."""

import math

import pytest
from pyspark.sql import functions as F

from newsmood import schemas
from newsmood.constants import (ALIASES, BACKFILL_SLOTS, LABELS, SUBJECTS, TRACKED_COUNTRIES)
from newsmood.functions import arrays, sentiment, text, timing
from newsmood.operators import dims
from newsmood.operators.lexicon import spoken_words, tokens


def one(df, **columns):
    return df.select(*[c.alias(n) for n, c in columns.items()]).collect()


@pytest.fixture(scope="module")
def row(spark):
    return spark.range(1)


@pytest.mark.parametrize("score,expected", [
    (-0.05, "negative"), (-0.0499, "neutral"), (0.0, "neutral"), (0.0499, "neutral"), (0.05, "positive"),
    (None, "neutral")])
def test_label_edges(row, score, expected):
    assert one(row, x=sentiment.label(F.lit(score).cast("double")))[0].x == expected


@pytest.mark.parametrize("label,expected", [
    ("negative", (1, 0, 0)), ("neutral", (0, 1, 0)), ("positive", (0, 0, 1)), (None, (0, 1, 0))])
def test_count_struct_and_sql_function(spark, row, label, expected):
    sentiment.register_sql_functions(spark)
    lit = F.lit(label).cast("string")
    got = one(row, x=sentiment.count_struct(lit), y=F.call_function("senti_count", lit))[0]
    assert tuple(got.x) == expected and tuple(got.y) == expected


def test_sum_counts_null_policy(spark):
    df = spark.sql("""SELECT k, c FROM VALUES
        ('full', named_struct('negative', 1, 'neutral', 2, 'positive', 3)),
        ('full', named_struct('negative', 4, 'neutral', 5, 'positive', 6)),
        ('gap', named_struct('negative', 1, 'neutral', 2, 'positive', 3)), ('gap', NULL) AS t(k, c)""")
    rows = {r.k: r for r in df.groupBy("k").agg(
        sentiment.sum_counts(F.col("c")).alias("strict"), sentiment.sum_counts(F.col("c"), "skip").alias("skip")
    ).collect()}
    assert tuple(rows["full"].strict) == (5, 7, 9) == tuple(rows["full"].skip)
    assert tuple(rows["gap"].strict) == (None, None, None) and tuple(rows["gap"].skip) == (1, 2, 3)
    empty = df.where("k = 'none'").agg(sentiment.sum_counts(F.col("c")).alias("c")).collect()[0].c
    assert tuple(empty) == (0, 0, 0)
    with pytest.raises(ValueError):
        sentiment.sum_counts(F.col("c"), "other")


def test_scores(row):
    got = one(row, p=sentiment.polarity(F.lit(0.7), F.lit(0.2)),
              c=sentiment.class_compound(F.lit(0.2), F.lit(0.1), F.lit(0.7)),
              n=sentiment.net_score(F.lit(1), F.lit(2), F.lit(4)),
              low=sentiment.net_score(F.lit(4), F.lit(0), F.lit(0)),
              zero=sentiment.net_score(F.lit(3), F.lit(0), F.lit(3)),
              w=sentiment.domain_weight(F.lit(1.0)),
              s=sentiment.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(1000.0))))[0]
    assert got.p == pytest.approx(math.tanh(0.5)) and got.c == pytest.approx(0.5 / 1.1)
    assert got.n == pytest.approx(3 / 5) and got.low == -1.0 and got.zero is None
    assert got.w == pytest.approx(1 / (math.log(11) + 1) + 0.68)
    assert got.s == [0.0, 0.0, 1.0]


def test_softmax_digits(row):
    values = [0.3, -1.2, 0.9]
    total = sum(math.exp(v) for v in values)
    got = one(row, s=sentiment.softmax(F.array(*[F.lit(v) for v in values])))[0].s
    assert got == [round(math.exp(v) / total, 4) for v in values]


def test_arrays(row):
    a = F.array(F.lit(1), F.lit(2))
    none = F.lit(None).cast("array<int>")
    got = one(row, first=arrays.subscript(a, 1), beyond=arrays.subscript(a, 3), zero=arrays.subscript(a, 0),
              null=arrays.subscript(none, 1), n=arrays.length_or_null(a),
              empty=arrays.length_or_null(F.array().cast("array<int>")), absent=arrays.length_or_null(none),
              piece=arrays.one_slice(F.array(a, F.array(F.lit(3), F.lit(4))), 2),
              parsed=arrays.parse_composite(F.lit("(1,22,333)")), bad=arrays.parse_composite(F.lit("(1,,x)")))[0]
    assert (got.first, got.beyond, got.zero, got.null) == (1, None, None, None)
    assert (got.n, got.empty, got.absent) == (2, None, None)
    assert got.piece == [3, 4] and got.parsed == [1, 22, 333] and got.bad == [1, None, None]


def test_composite_round_trip(row):
    counts = F.struct(F.lit(3).alias("negative"), F.lit(0).alias("neutral"), F.lit(12).alias("positive"))
    got = one(row, s=arrays.format_composite(counts), n=arrays.parse_composite(arrays.format_composite(counts)))[0]
    assert got.s == "(3,0,12)" and got.n == [3, 0, 12]


def test_text(row):
    lit = F.lit
    got = one(
        row, mask=text.mask_handles(lit("@me @ see http://x.y/z and https://q a@b")),
        squeezed=text.squeeze(lit(" South\tAfrica \n")), safe=text.safe_name(lit("a 10:20:30")),
        split=text.split_terms(lit("A x OR A y")), joined=text.join_terms(lit("Chad"), ["Trade", "Energy"]),
        minus=text.with_scope_prefix(lit("Chad"), lit(True)), plus=text.strip_scope_prefix(lit("-Chad")),
        same=text.strip_scope_prefix(lit("Guinea-Bissau")), zh=text.translator_language(lit("Chinese")),
        fr=text.translator_language(lit("French")), line=text.one_line(lit("a\nb")),
        tw=text.strip_network_name(lit("77KTwitter")), ig=text.strip_network_name(lit("5MInstagram")),
        words=text.words(lit("Éa b-c, D2")), prefix=text.country_prefix(lit("NO_coast")),
        code=text.file_country_code(lit("ranked-domains-top-NO-2024.csv")))[0]
    assert got.mask == "@user @ see http and http a@b"
    assert got.squeezed == "SouthAfrica" and got.safe == "a 10_20_30"
    assert got.split == ["A x", "A y"] and got.joined == "Chad Trade OR Chad Energy"
    assert (got.minus, got.plus, got.same) == ("-Chad", "Chad", "Guinea-Bissau")
    assert (got.zh, got.fr, got.line) == ("chinese (simplified)", "french", "a b")
    assert (got.tw, got.ig) == ("77K", "5M")
    assert got.words == ["éa", "b", "c", "d"] and got.prefix == "NO" and got.code == "NO"


@pytest.mark.parametrize("word,expected", [
    ("good", "good"), ("good!", "good"), ("good!!!", "good"), ("good!!!!", "good!!!!"), ("\"good", "good"),
    ("\"good\"", "\"good\""), ("don't", "don't"), ("don't!", "don't!"), ("a!", "a!"), (":)", ":)"),
    ("(good", "(good"), ("good).", "good).")])
def test_bare_word(row, word, expected):
    assert one(row, x=spoken_words(F.lit(f"a {word} \t")))[0].x == ([expected] if len(expected) > 1 else [])


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Ab cd")], "id int, t string")
    assert [tuple(r) for r in tokens(df, "t", ["id"]).collect()] == [(1, 0, "ab"), (1, 1, "cd")]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_slots_do_not_depend_on_the_session_zone(spark, row, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ts = timing.ntz("2025-03-30 02:30:15.25")
        got = one(row, slot=timing.slot_start(ts).cast("string"), back=timing.from_instant(timing.to_instant(ts)).cast("string"),
                  epoch=timing.epoch_seconds(ts), again=timing.from_epoch_seconds(timing.epoch_seconds(ts)).cast("string"),
                  old=timing.slot_start(timing.ntz("1969-12-31 23:00:00")).cast("string"))[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got.slot == "2025-03-30 00:00:00" and got.back == "2025-03-30 02:30:15.25"
    assert got.epoch == 1743301815 and got.again == "2025-03-30 02:30:15" and got.old == "1969-12-31 20:00:00"


def test_slot_series_and_bounds(spark):
    slots = [str(r.slot) for r in timing.slot_series(spark, "2025-02-01 12:00:00").orderBy("slot").collect()]
    assert len(slots) == BACKFILL_SLOTS == 58 and slots[0] == "2025-02-01 12:00:00" and slots[-1] == "2025-02-11 00:00:00"
    end = timing.ntz("2025-01-01 08:00:00")
    times = spark.createDataFrame([("2025-01-01 03:59:59",), ("2025-01-01 04:00:00",), ("2025-01-01 08:00:00",)], "t string")
    inside = [r.x for r in times.select(timing.in_slot(F.col("t").cast("timestamp_ntz"), end).alias("x")).collect()]
    assert inside == [False, True, False]


def test_time_keys(row):
    ts = timing.ntz("2025-01-02 03:04:05")
    got = one(row, s=timing.second_key(ts), h=timing.hour_key(ts), d=timing.day_key(ts),
              hour=timing.hour_start(ts).cast("string"), b=timing.shift_days(ts, -1).cast("string"),
              f=timing.shift_hours(ts, -4).cast("string"))[0]
    assert (got.s, got.h, got.d) == ("20250102030405", "2025-01-02-03", "20250102")
    assert (got.hour, got.b, got.f) == ("2025-01-02 03:00:00", "2025-01-01 03:04:05", "2025-01-01 23:04:05")


def test_fixed_values():
    assert len(TRACKED_COUNTRIES) == 150 == len(set(TRACKED_COUNTRIES)) and len(SUBJECTS) == 15 and len(ALIASES) == 3


def test_dimensions(spark):
    assert dims.country_dim(spark).count() == 150 and dims.subject_dim(spark).count() == 15
    assert {r.alias for r in dims.alias_dim(spark).collect()} == set(ALIASES.values())
    slots = timing.slot_series(spark, "2025-01-01", 2)
    grid = dims.work_grid(slots, TRACKED_COUNTRIES, SUBJECTS)
    assert grid.count() == 2 * 150 * 15 == grid.distinct().count()


def test_codes(spark):
    codes = spark.createDataFrame([("Chad", "TD"), ("B", "PS"), ("A", "PS")], "name string, code string")
    df = spark.createDataFrame([("Chad",), ("Nowhere",)], "country string")
    got = {r.country: r.country_code for r in dims.with_code(df, codes, "country").collect()}
    assert got == {"Chad": "TD", "Nowhere": "Nowhere"}
    with pytest.raises(Exception, match="no code for country: Nowhere"):
        dims.with_code(df, codes, "country", unknown="error").collect()
    used = spark.createDataFrame([("PS",), ("TD",), ("ZZ",)], "code string")
    assert {r.code: r.country for r in dims.with_name(used, codes, "code").collect()} == {
        "PS": "A", "TD": "Chad", "ZZ": "World"}
    names = spark.createDataFrame([("Moldova",), ("Chad",)], "n string")
    assert sorted(r.n for r in dims.with_alias(names, ALIASES, "n").collect()) == ["Chad", "Moldavia"]
    assert dims.registered_codes(spark.sql("SELECT * FROM VALUES ('a'), (NULL) AS t(country_code)")).collect()[0].codes == 1


def test_label_check(row):
    assert one(row, x=schemas.checked_label(F.lit("neutral"), LABELS))[0].x == "neutral"
    with pytest.raises(Exception, match="not a label: happy"):
        one(row, x=schemas.checked_label(F.lit("happy"), LABELS))
