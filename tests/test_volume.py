"""What holds at volume: ranges instead of groups, batches of bounded size, each title once, deltas, closed slots."""

import json
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsmood import schemas
from newsmood.operators import models, outlets, translation
from newsmood.operators.lexicon import lexicon_score, speakable, spoken_words
from newsmood.operators.skew import positions_by_range
from newsmood.plans import deltas, ingest
from newsmood.sources import readers, shared, writers
from newsmood.streaming import load as stream_load
from newsmood.streaming import slots as stream
from workload import fixtures as fx
from workload import queries

FACT = "target_country string, scope string, model string, neg double, positive double, compound double, day string"


def test_positions_of_a_hot_group_by_range(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(500), i) for i in range(2_000)] + [("cold", 1, i) for i in range(5)] + [(None, None, 9)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = positions_by_range(df, ["k"], [F.col("v").desc(), F.col("id").asc()], "pos").collect()
    for key in ("hot", "cold", None):
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine)))
        assert mine == sorted(mine, key=lambda r: (-(r.v or 0), r.id))


def test_batches_are_bounded_and_hold_each_title_once(spark):
    rng = random.Random(2)
    titles = ["x" * rng.choice([1, 5, 40, 90, 400]) + f" {rng.randrange(700)}" for _ in range(1_500)]
    rows = [(i, "French" if i % 3 else "Chinese", t) for i, t in enumerate(titles)] + [(9_000, "English", "yes"), (9_001, "French", None)]
    df = spark.createDataFrame(rows, "id int, language string, title string")
    got = translation.batches(translation.different_titles(df), most=20, budget=600).collect()
    assert Counter((r.language, r.title) for r in got) == Counter({(lang, t) for _, lang, t in rows if lang != "English" and t})
    sizes, chars = Counter(), Counter()
    for r in got:
        sizes[r.language, r.batch] += 1
        chars[r.language, r.batch] += r.chars
    assert max(sizes.values()) <= 20
    assert all(n <= 600 or sizes[b] == 1 for b, n in chars.items())
    short = {b: n for b, n in sizes.items() if not b[1].startswith("long")}
    assert len(short) < sum(short.values()) / 5


def test_memory_asks_for_new_titles_and_failures_only(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def translator(run):
        def call(language, titles):
            import os
            import uuid
            os.makedirs(f"{asked}{run}", exist_ok=True)
            with open(f"{asked}{run}/{uuid.uuid4().hex}", "w") as out:
                json.dump([language, titles], out)
            return [None if t == "fails" and run == 1 else f"{run}:{t}" for t in titles]

        return call

    def calls(run):
        import glob
        return sorted(tuple([lang, t]) for f in glob.glob(f"{asked}{run}/*") for lang, ts in [json.load(open(f))] for t in ts)

    schema, path = "id int, language string, title string", str(tmp_path / "memory")
    first = spark.createDataFrame([(1, "French", "a"), (2, "French", "a"), (3, "Chinese", "a"), (4, "French", "fails"),
                                   (5, "English", "e"), (6, "French", None)], schema)
    translation.remember(first, path, translator(1))
    assert calls(1) == [("chinese (simplified)", "a"), ("french", "a"), ("french", "fails")]
    more = first.unionByName(spark.createDataFrame([(7, "French", "new")], schema))
    memory = translation.remember(more, path, translator(2))
    assert calls(2) == [("french", "fails"), ("french", "new")]
    got = {r.id: r.title for r in translation.from_memory(more, memory, by=["id"]).collect()}
    assert got == {1: "1:a", 2: "1:a", 3: "1:a", 4: "2:fails", 5: "e", 7: "2:new"}


def test_the_model_sees_each_title_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def make():
        import os
        import uuid

        import numpy as np
        os.makedirs(seen, exist_ok=True)

        def score(titles):
            with open(f"{seen}/{uuid.uuid4().hex}", "w") as out:
                json.dump([str(t) for t in titles], out)
            return np.array([[len(t), 1.0, 2.0] for t in titles])

        return score

    def sent():
        import glob
        batches = [json.load(open(f)) for f in glob.glob(f"{seen}/*")]
        assert all([len(t) for t in b] == sorted(len(t) for t in b) for b in batches)  # like lengths together
        return sorted(t for b in batches for t in b)

    rows = [(i, "hot title") for i in range(300)] + [(300 + i, "x" * (i % 40 + 1)) for i in range(600)] + [(1_000, None)]
    df = spark.createDataFrame(rows, "id int, title string").repartition(6)
    path = str(tmp_path / "scores")
    got = models.classify_once(df, make, path, by=["id"]).collect()
    assert sent() == sorted({t for _, t in rows if t})
    plain = {r.id: r for r in models.classify(df.where("title IS NOT NULL"), make).collect()}
    assert len(got) == len(rows) and all(r.neg is None if r.title is None else r == plain[r.id] for r in got)
    import shutil
    shutil.rmtree(seen)
    models.classify_once(df, make, path, by=["id"]).collect()
    assert sent() == []


def _fact(spark, rows):
    df = spark.createDataFrame([(*r[:3], 0.0, 0.0, r[3], r[4]) for r in rows], FACT)
    return df.withColumn("day", F.col("day").cast("date")).withColumn("slot", F.col("day").cast("timestamp_ntz"))


def test_deltas_equal_the_counts_of_what_is_left(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "rollup")
    row = lambda: (rng.choice("ABC"), rng.choice(["national", "international"]), "lexicon", rng.choice([-0.9, 0.0, 0.9]),
                   rng.choice(["2025-01-01", "2025-01-02", None]))
    alive, first = [], None
    for number in range(4):
        added = [row() for _ in range(60)]
        gone = [alive.pop(rng.randrange(len(alive))) for _ in range(len(alive) // 2)]
        if number == 3:  # a day that loses everything
            gone += [r for r in alive if r[4] == "2025-01-02"]
            alive = [r for r in alive if r[4] != "2025-01-02"]
            added = [r for r in added if r[4] != "2025-01-02"]
        alive += added
        change = deltas.delta(_fact(spark, added), _fact(spark, gone) if gone else None)
        first = first or change
        for _ in range(2):  # a batch that is run again adds nothing
            deltas.merge(change, path, number)
        deltas.merge(first, path, 0)
        names = ["target_country", "slot", "scope", "model", "negative", "neutral", "positive", "day"]
        want = ingest.count_labels(_fact(spark, alive)).select(*names)
        assert Counter(deltas.read(spark, path, first).select(*names).collect()) == Counter(want.collect())
    with pytest.raises(ValueError):
        deltas.delta()


def test_a_day_that_is_not_touched_is_not_written(spark, tmp_path):
    import glob
    import os
    path = str(tmp_path / "rollup")
    deltas.merge(deltas.delta(_fact(spark, [("A", "national", "lexicon", 0.9, d) for d in ("2025-01-01", "2025-01-02")])), path, 0)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/day=2025-01-01/*.parquet")}
    deltas.merge(deltas.delta(_fact(spark, [("B", "national", "lexicon", 0.9, "2025-01-02")])), path, 1)
    assert before == {f: os.path.getmtime(f) for f in glob.glob(f"{path}/day=2025-01-01/*.parquet")}


def test_state_falls_when_slots_close(spark, tmp_path):
    """Rows of one slot are state until the watermark has passed it; a late row is left out and counted."""
    landed = str(tmp_path / "landed")

    def land(*rows):
        articles = [{"url": u, "title": t, "seendate": s, "domain": "d", "language": "English", "sourcecountry": "India"}
                    for u, t, s in rows]
        spark.createDataFrame([(json.dumps({"articles": articles}),)], "value string").write.mode("append").text(landed)

    codes = spark.createDataFrame([("India", "IN"), ("Chad", "TD")], "name string, code string")
    relevant = spark.createDataFrame([("d", ["IN"])], "domain string, codes array<string>")
    lexicon = spark.createDataFrame([("good", 1.9)], "token string, valence double")

    def run():
        titles = stream_load.closed_titles(stream_load.read_articles(spark, landed), {"India": "India", "Chad": "Chad"},
                                           "1 hour", ["trade"])
        query = stream_load.start_load(titles, str(tmp_path / "fact"), str(tmp_path / "cp"), codes, relevant, lexicon)
        query.awaitTermination()
        state = query.recentProgress[-1].stateOperators[0]
        stored = readers.read_fact(spark, str(tmp_path / "fact")) if (tmp_path / "fact").exists() else None
        return state.numRowsTotal, stream.late_rows(query), stored

    land(("u2", "good India trade", "20250101T010000Z"), ("u1", "good India trade", "20250101T010000Z"),
         ("u3", "India and Chad trade", "20250101T020000Z"))
    held, late, stored = run()
    assert (held, late, stored) == (3, 0, None)  # two titles for India, one for Chad
    land(("u4", "India trade later", "20250101T091500Z"), ("u5", "good India trade", "20250101T034500Z"))
    held, late, stored = run()
    assert (held, late) == (1, 0)
    rows = [(r.target_country, r.scope, r.title) for r in stored.collect()]
    assert rows == []  # neither country has both scopes
    land(("u6", "India trade too late", "20250101T033000Z"), ("u7", "India trade", "20250101T170000Z"))
    held, late, _ = run()
    assert (held, late) == (1, 1)


def test_state_holds_a_title_once(spark, tmp_path, monkeypatch):
    """A title that names three countries is in the state, and in the batch that leaves it, with the first of them only."""
    stored, store = [], stream_load.materialise
    monkeypatch.setattr(stream_load, "materialise", lambda df, label: stored.append(store(df, label)) or stored[-1])
    articles = [{"url": f"u{n}", "title": f"Chad India Mali trade {n % 2}", "seendate": "20250101T010000Z", "domain": "d",
                 "language": "English", "sourcecountry": c} for n, c in enumerate(["Chad", "Chad", "India", "India"])]
    articles.append({**articles[0], "title": "nothing", "seendate": "20250101T091500Z"})
    late = {**articles[0], "url": "v", "title": "Mali trade", "seendate": "20250101T091500Z"}
    lines = [(json.dumps({"articles": a}),) for a in (articles, [late])]
    for _ in range(2):
        spark.createDataFrame(lines, "value string").write.mode("append").text(str(tmp_path / "landed"))
    names = ["Chad", "India", "Mali"]
    titles = stream_load.closed_titles(stream_load.read_articles(spark, str(tmp_path / "landed")), {n: n for n in names},
                                       "1 hour", ["trade"])
    stream_load.start_load(
        titles, str(tmp_path / "fact"), str(tmp_path / "cp"), spark.createDataFrame([(n, n) for n in names], "name string, code string"),
        spark.createDataFrame([("d", names)], "domain string, codes array<string>"),
        spark.createDataFrame([("good", 1.9)], "token string, valence double")).awaitTermination()
    closed = [r for batch in stored for r in batch.collect()]
    assert len(closed) == 2 * 5  # Chad and India from there and from abroad, Mali from abroad
    assert {(r.target_country, r.title) for r in closed if r.title is not None} == {
        ("Chad", f"Chad India Mali trade {n}") for n in range(2)}
    fact = readers.read_fact(spark, str(tmp_path / "fact")).collect()
    assert sorted((r.target_country, r.title) for r in fact) == sorted(
        (c, f"Chad India Mali trade {n}") for c in ("Chad", "Chad", "India", "India") for n in range(2))


def test_clustered_table_is_joined_without_an_exchange(spark):
    rows = spark.range(5_000).select((F.col("id") % 50).cast("string").alias("c"), (F.col("id") % 7).alias("s"), "id")
    writers.save_clustered(rows, "clustered_test", ["c", "s"], 4)
    stored = spark.table("clustered_test")
    grid = spark.createDataFrame([("1", 1), ("99", 1)], "c string, s long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pending = grid.join(stored.select("c", "s").distinct(), ["c", "s"], "left_anti")
        plan = pending._jdf.queryExecution().executedPlan().toString()
        assert [r.c for r in pending.collect()] == ["99"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = plan[plan.index("FileScan"):]
    assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 4 out of 4" in scan  # the grid is shuffled, the table is not
    one = stored.where("c = '7' AND s = 0")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c), IsNotNull(s), EqualTo(c,7)" in one
    spark.sql("DROP TABLE clustered_test")


def test_pages_are_put_in_place_by_folder(spark, monkeypatch):
    """A file for each page, but few folders for the driver to move; the reader goes down into them."""
    import glob
    monkeypatch.setattr(queries, "PAGE_FOLDERS", 8)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("page "), F.col("id")).alias("value"))
    path = queries._pages_as_files(spark, pages)
    folders = [f for f in glob.glob(path) if not f.endswith("_SUCCESS")]
    assert 1 < len(folders) <= 8 and len(glob.glob(f"{path}/*/*.txt")) == 300
    read = readers.read_pages(spark, path, nested=True)
    assert sorted((r.path.split("page_id=")[1].split("/")[0], r.text.strip()) for r in read.collect()) == sorted(
        (str(i), f"page {i}") for i in range(300))
    pieces = readers.read_marked(spark, path, "Media Outlet", nested=True)
    assert sorted(r.value.strip() for r in pieces.collect()) == sorted(f"page {i}" for i in range(300))


def test_pages_that_repeat_share_a_file(spark, monkeypatch):
    """The files that Spark's writer makes, whatever the rows, but without sums of their own beside them."""
    import glob
    import os
    monkeypatch.setattr(queries, "PAGE_FOLDERS", 4)
    pages = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "d"), (-3, "\u00e9\nf"), (2**62, "")],
                                  "page_id long, value string")
    path = queries._pages_as_files(spark, pages)
    files = [os.path.join(at, f) for top in glob.glob(path) for at, _, names in os.walk(top) for f in names]
    found = {}
    for f in files:
        with open(f, "rb") as opened:
            found[f.split("page_id=")[1].split("/")[0]] = sorted(opened.read().split(b"\n"))
    assert len(files) == 5 and all(f.endswith(".txt") for f in files)
    assert found == {"1": [b"", b"a", b"b"], "2": [b"", b""], "__HIVE_DEFAULT_PARTITION__": [b"", b"d"],
                     "-3": [b"", b"f", "\u00e9".encode()], str(2**62): [b"", b""]}


def test_outlets_are_extracted_once(spark):
    """Not again for the ranges of the sort."""
    text = f" Media Outlet a.example Domain Authority 88{' x' * 90} Media Outlet b.example Domain Authority 91 "
    found = outlets.extract_outlets(spark.createDataFrame([(1, text)], "page_id long, text string"), "text", ["page_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE" in plan[plan.index("rangepartitioning"):]
    assert [r.domain for r in found.collect()] == ["b.example", "a.example"]


ODD = ['plain', 'br}ace', '{"a":[}', 'quo"te', 'back\\slash', 'end\\', '\\"}', '}{', '', 'new\nline', None, '][,']


def test_json_arrays_are_split(spark, tmp_path):
    rng = random.Random(4)
    rows = [{"domain": rng.choice(ODD), "countrycode": f"C{i}", "cnt": i} for i in range(3_000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "in" / "b.json").write_text(json.dumps(rows[:40], separators=(",", ":")))
    (tmp_path / "in" / "c.json").write_text("[]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        split = spark.read.option("lineSep", "}").text(str(tmp_path / "in")).rdd.getNumPartitions()
        got = readers.read_json_array(spark, str(tmp_path / "in"), schemas.MENTION_COUNT).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert split > 5
    assert Counter(tuple(r) for r in got) == Counter((r["domain"], r["countrycode"], r["cnt"]) for r in rows + rows[:40])


def test_json_arrays_of_nested_objects(spark, tmp_path):
    rows = [{"a": {"b": "}" * i, "c": {"d": i}}, "e": [{"f": "{"}] * (i % 3)} for i in range(60)]
    (tmp_path / "n.json").write_text(json.dumps(rows))
    schema = spark.createDataFrame([], "a struct<b: string, c: struct<d: bigint>>, e array<struct<f: string>>").schema
    got = readers.read_json_array(spark, str(tmp_path / "n.json"), schema).collect()
    assert sorted((r.a.c.d, r.a.b, len(r.e)) for r in got) == [(i, "}" * i, i % 3) for i in range(60)]


@pytest.mark.parametrize("cell", [4096, 17])
def test_pages_of_any_size(spark, tmp_path, monkeypatch, cell):
    """Pages split over tasks give what they give as one row; marks come close together, at borders and over lines."""
    monkeypatch.setattr(outlets, "CELL", cell)
    rng = random.Random(5)
    parts = [" Media Outlet a{}.example Facebook Followers 7 Domain Authority 88 x", " Media Outlet ", "Media Outlet", " Media\nOutlet b.org "
             "Domain Authority 61 ", " text \n", " Domain Authority 77 ", " Media Outlet bbc.com Domain Authority 90 "]
    (tmp_path / "in").mkdir()
    for page in range(4):
        text = "".join(rng.choice(parts).format(rng.randrange(99)) for _ in range([3_000, 500, 40, 0][page]))
        if page == 1:
            text += " Media Outlet Contact us Media Outlet late.example Domain Authority 99 " * 3
        (tmp_path / "in" / f"{page}.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        assert spark.read.option("lineSep", "Media Outlet").text(str(tmp_path / "in")).rdd.getNumPartitions() > 6
        split = outlets.extract_from_pieces(readers.read_marked(spark, str(tmp_path / "in"), "Media Outlet")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = outlets.extract_outlets(readers.read_pages(spark, str(tmp_path / "in")), "text", ["path"]).collect()
    assert len(whole) > 500
    assert Counter(map(tuple, split)) == Counter(map(tuple, whole))


def test_counters_of_the_same_pass(spark, tmp_path):
    flagged = spark.createDataFrame([("A", "national", True), ("A", "national", False), ("B", "national", False)],
                                    "target_country string, scope string, relevant boolean")
    got = ingest.write_counted(flagged, str(tmp_path / "out"), [(c, s) for c in "ABC" for s in ("national", "international")])
    assert sorted(map(tuple, got.collect())) == [("A", "national", "kept", 1), ("A", "national", "removed", 1),
                                                 ("B", "national", "kept", 0), ("B", "national", "removed", 1)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_broken_payloads_are_kept(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"articles": [{"title": "t", "seendate": "20250101T000000Z"}]}\n{"articles": [{"ti\n{}\n')
    payloads = readers.read_payloads(spark, str(tmp_path / "p.json")).cache()
    assert [r.broken for r in payloads.where("broken IS NOT NULL").collect()] == ['{"articles": [{"ti']
    assert [r.title for r in readers.article_rows(payloads.drop("broken")).collect()] == ["t"]
    payloads.unpersist()


def test_rank_files_carry_the_code(spark, tmp_path):
    ranks = fx.ranks(spark.createDataFrame([("a.x", "US", 5), ("b.x", "US", 9), ("c.x", "IN", 1)], "domain string, code string, cnt long"))
    writers.write_ranks(ranks, str(tmp_path / "ranks"))
    got = sorted(map(tuple, readers.read_ranks(spark, str(tmp_path / "ranks")).collect()))
    assert got == [("a.x", "US", 2.0), ("b.x", "US", 1.0), ("c.x", "IN", 1.0)]


def test_an_array_file_is_written_by_batches_not_by_rows(spark, tmp_path):
    frames = [pd.DataFrame({"value": [f'{{"domain":"d{i}"}}' for i in part]}) for part in (range(3), (), range(3, 1_000))]
    lines = list(fx.array_lines()(iter(frames)))
    assert [len(f) for f in lines] == [3, 997, 1]
    assert [r["domain"] for r in json.loads("".join(v for f in lines for v in f["value"]))] == [f"d{i}" for i in range(1_000)]
    rows = spark.range(5_000).select(F.format_string('{"}%d', "id").alias("domain"), F.lit("01").alias("countrycode"), F.col("id").alias("cnt"))
    fx.array_file(rows, str(tmp_path / "array"))
    assert len([p for p in (tmp_path / "array").iterdir() if p.name.startswith("part-")]) == 1
    got = readers.read_json_array(spark, str(tmp_path / "array"), schemas.MENTION_COUNT).collect()
    assert sorted((r.cnt, r.domain) for r in got) == [(i, f'{{"}}{i}') for i in range(5_000)]


def test_phrases_as_a_table_travel_alone_and_score_as_a_dictionary(spark):
    words = ["good", "bad", "the", "a1", "b2", "c3"]
    rng = random.Random(5)
    said = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(said)] + [(7, said[7]), (None, said[3]), (None, said[3]), (80, None), (81, "")]
    texts = spark.createDataFrame(rows, "id int, text string")
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    pairs = [f"{a} {b}" for a in words for b in words]
    phrases = {p: (len(p) * i) % 7 - 3.0 for i, p in enumerate([p for p in pairs if rng.random() < 0.2]
                                                               + [f"{p} {w}" for p in pairs for w in words if rng.random() < 0.2])}
    table = spark.createDataFrame([*phrases.items(), *[(p, v - 1) for p, v in phrases.items()], (None, 1.0), ("good bad a1 the", 3.0),
                                   ("good", 2.0), *[(p, None) for p in pairs]], "phrase string, value double")
    by_table = lexicon_score(texts, lexicon, "text", ["id"], table)
    listed = lexicon_score(texts, lexicon, "text", ["id"], phrases)
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(by_table) == order(listed) != order(lexicon_score(texts, lexicon, "text", ["id"]))

    def kinds(node):
        yield from (node.output().apply(i).dataType().typeName() for i in range(node.output().size()))
        for i in range(node.children().size()):
            yield from kinds(node.children().apply(i))

    # all that goes on after a phrase would otherwise travel with every word that stands before it
    for df in (by_table, listed):
        assert "map" not in set(kinds(df._jdf.queryExecution().optimizedPlan()))


def test_counters_keep_no_copy_of_the_payloads(spark, sf):
    made = shared._MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    counted = {r.kind: r.n for r in queries.load_counters(spark, sf).where("kind = 'broken'").collect()}
    assert counted["broken"] > 0
    labels = {p.rpartition("/")[2].rpartition("-")[0] for p in made[before:]}
    assert "flagged" in labels and "payloads" not in labels


def test_phrases_that_cannot_be_spoken_are_not_shuffled(spark):
    """Every phrase of spoken words may be sought; one with a short word, or one that loses a mark, never is."""
    rng = random.Random(8)
    raw = ["ab", "a", "-", "ab.", "'ab", "'ab'", "ab!!", "a.b", "\u00e9", "\u00e9t", "x-y,", "...", "!a", "?!?ab", "\U0001f600", "AB", "a\u00a0b"]
    texts = spark.createDataFrame([(" ".join(rng.choices(raw, k=40)),) for _ in range(50)], "text string")
    spoken = [r.w for r in texts.select(spoken_words(F.col("text")).alias("w")).collect()]
    sought = {" ".join(w[i:i + n]) for w in spoken for n in (2, 3) for i in range(len(w) - n + 1)}
    other = {"ab a", "ab ab.", "'ab ab", "ab \u00e9", "ab ab!! ab", "- ab", "ab \U0001f600", ""}
    phrases = spark.createDataFrame([(p,) for p in sought | other], "phrase string")
    kept = speakable(phrases.distinct().withColumn("value", F.lit(1.0)))
    assert len(sought) > 200 and {r.phrase for r in kept.collect()} == sought
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RLIKE")


def test_the_first_phrase_is_sought_before_the_others(spark):
    """The longest phrase decides; a word without it goes on to the others, and one without any keeps its score."""
    lexicon = spark.createDataFrame([("good", 2.0)], "token string, valence double")
    text = "aa bb cc good dd ee"
    texts = spark.createDataFrame([(0, text), (0, text), (1, "aa bb cc good dd ee ff"), (2, "aa bb cc good"), (3, "aa bb cc good xx ee"),
                                   (4, "zz yy xx good ww vv")], "id long, text string")
    phrases = {"good dd ee": -3.0, "cc good": 1.0, "aa bb": 0.5, "good xx": -1.0, "good dd": 3.0}
    table = spark.createDataFrame([*phrases.items()], "phrase string, value double")
    got = lexicon_score(texts, lexicon, "text", ["id"], table)
    listed = lexicon_score(texts, lexicon, "text", ["id"], phrases)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.collect()))
    assert {r.id: r.compound > 0 for r in got.collect()} == {0: False, 1: False, 2: True, 3: False, 4: True}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter, ((") == 2  # by the first, by the others
