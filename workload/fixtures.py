"""The engine's input shapes, derived from the given tables (whole tables, no subsets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.constants import CLASSIFIER, INTERNATIONAL, LEXICON, NATIONAL
from newsmood.functions.sentiment import class_compound, count_struct, label, polarity, softmax
from newsmood.functions.timing import hour_key, ntz
from newsmood.operators import domains as dom
from newsmood.operators.articles import scope_pairs
from newsmood.operators.labels import tally_labels
from newsmood.operators.nested import CHUNK, to_nested
from newsmood.operators.skew import positions, positions_by_range

FIRST_SLOT = "2025-01-01 00:00:00"
MIN_MENTIONS, MIN_WEIGHT = 40, 0.966
ENGLISH = "en"

# Parameters of the fixtures: the words that name each nation, subjects, and a small lexicon over frequent words.
NATION_TERMS = [
    "thble", "thtion", "thing", "attion", "erble", "ertion", "ering", "thanea", "eriner", "oning", "ontion",
    "thanedble", "antion", "retion", "onble", "reing", "aning", "heble", "nicht", "ining", "anble", "inble",
    "reble", "thon thth", "than erin",
]
COUNTRY_TERMS = {f"NATION_{i}": term for i, term in enumerate(NATION_TERMS)}
SUBJECTS = ["that from", "nicht", "la", "que"]
HEADLINE_SUBJECTS = ["Climate", "Economy", "Trade"]
LEXICON_WORDS = [
    ("the", 0.4), ("that", -0.6), ("to", 1.3), ("is", -1.7), ("it", 2.1), ("der", 0.9), ("die", -1.1),
    ("und", 1.6), ("nicht", -2.2), ("de", 0.7), ("la", 1.2), ("le", -0.8), ("et", 1.9), ("es", -1.4),
    ("el", 0.5), ("les", -2.6), ("kind", 2.4),
]
IDIOMS = {"de la": 3.0, "not the": -1.5, "la que": 1.1, "hardly so the": 2.5, "it VERY": -0.5}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def slot_at(index: Column) -> Column:
    return F.timestamp_add("HOUR", (index * 4).cast("int"), ntz(FIRST_SLOT))


def code_of(nationkey: str) -> Column:
    return F.lpad(F.col(nationkey).cast("string"), 2, "0")


def codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("name"), code_of("n_nationkey").alias("code"))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier")
    n = suppliers.agg(F.count(F.lit(1)).alias("n")).scalar()
    docs = documents(spark, sf).withColumn("s_suppkey", F.col("doc_id") % n)
    slot = slot_at(F.col("doc_id") % 6)
    # One dimension after the other: each is then judged for a broadcast by its own file size.
    placed = (docs.join(suppliers, "s_suppkey")
              .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")))
    return placed.select(
        "doc_id", F.concat(F.lit("http://news.example/"), F.col("doc_id")).alias("url"),
        F.col("text").alias("title"), F.col("lang").alias("language"), F.col("s_name").alias("domain"),
        F.col("n_name").alias("source_country"),
        slot.alias("slot"),
        F.timestamp_add("SECOND", (F.col("doc_id") % 14400).cast("int"), slot).alias("seen"))


def payloads(rows: DataFrame) -> DataFrame:
    """Articles as the payloads of a service, seven to one."""
    item = F.struct(
        "url", F.col("title"), F.date_format("seen", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), "domain", "language",
        F.col("source_country").alias("sourcecountry"))
    return (rows.groupBy(F.floor(F.col("doc_id") / 7).alias("payload"))
            .agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("a")))).alias("rows"))
            .select(F.to_json(F.struct(F.transform("rows", lambda r: r["a"]).alias("articles"))).alias("value")))


def array_lines():
    """The lines of a JSON array out of batches of its objects, a frame for a batch."""
    def run(batches):
        import pandas as pd

        opening = "["
        for batch in batches:
            if len(batch):
                values = "," + batch["value"]
                values.iloc[0] = opening + values.iloc[0][1:]
                opening = ","
                yield values.to_frame()
        yield pd.DataFrame({"value": ["]"]})

    return run


def array_file(rows: DataFrame, path: str) -> None:
    """Rows as one JSON array in one file. One task writes it, batch by batch; the rows come to it as text, so that what
    they are made of is computed by as many tasks as otherwise."""
    (rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).repartition(1)
     .mapInPandas(array_lines(), "value string").write.text(path))


def make_scorer():
    """A classifier whose raw scores are remainders of the text's length."""
    import numpy as np

    return lambda titles: np.array([[len(t) % 5, len(t) % 3, len(t) % 7] for t in titles], dtype=float) / 2


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Every two and every three words that follow each other in a document, with a score by their length."""
    def runs(n: int) -> DataFrame:
        words = documents(spark, sf).select(F.split("text", r"\s+").alias("w")).where(F.size("w") >= n)
        starts = F.sequence(F.lit(1), F.size("w") - n + 1)
        return words.select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("phrase"))

    return runs(2).unionByName(runs(3)).distinct().withColumn("value", F.length("phrase") % 9 - F.lit(4.5))


def pairs(spark: SparkSession, sf: str, subjects: list[str] | None = None) -> DataFrame:
    """(article, target) pairs with scope and the target's code."""
    rows = scope_pairs(articles(spark, sf), COUNTRY_TERMS, subjects, by=["doc_id"])
    return (rows.join(codes(spark, sf).select(F.col("name").alias("target_country"),
                                              F.col("code").alias("target_code")), "target_country"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """How often customers of a nation bought from a supplier, as mention counts of a domain by a country."""
    sold = (table(spark, sf, "lineitem")
            .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("l_suppkey", "c_nationkey").agg(F.count(F.lit(1)).alias("cnt")))
    return (sold.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("s_name").alias("domain"), code_of("c_nationkey").alias("code"), "cnt"))


def ranks(mentioned: DataFrame) -> DataFrame:
    """The domains of each country by their mentions."""
    placed = positions_by_range(mentioned, ["code"], [F.col("cnt").desc(), F.col("domain").asc()], "place")
    return placed.select("domain", "code", (F.col("place") + 1).cast("double").alias("rank"))


def authority(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with an authority, and the regions, which nothing mentions."""
    known = table(spark, sf, "supplier").select(
        F.col("s_name").alias("domain"),
        F.floor(F.col("s_acctbal") / 100).cast("string").alias("domain_auth"))
    extra = table(spark, sf, "region").select(
        F.col("r_name").alias("domain"), (F.col("r_regionkey") * 20).cast("string").alias("domain_auth"))
    return known.unionByName(extra)


def domain_info(spark: SparkSession, sf: str) -> DataFrame:
    mentioned = mentions(spark, sf)
    return dom.build_domain_info(mentioned, ranks(mentioned), authority(spark, sf),
                                 change_date=F.lit("20250101000000"))


def relevant(spark: SparkSession, sf: str) -> DataFrame:
    return dom.relevant_domains(domain_info(spark, sf), MIN_MENTIONS, MIN_WEIGHT)


def wide_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One row per headline, out of the whole vector: every third element adds to a class, every second to the sign of
    the lexicon score, and a headline has the subjects whose third is positive."""
    def folded(of: int, rest: int) -> Column:
        part = F.filter("embedding", lambda _, i: i % of == rest)
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double"))

    thirds = [folded(3, r) for r in range(3)]
    compound = F.round(F.tanh(folded(2, 0) - folded(2, 1)), 4)
    raw = F.array(*[t * F.lit(2.0) for t in thirds])
    subjects = F.array_compact(F.array(*[F.when(t > 0, s) for t, s in zip(thirds, HEADLINE_SUBJECTS, strict=True)]))
    base = table(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("NATION_"), F.col("label")).alias("target_country"),
        slot_at(F.col("vec_id") % 6).alias("slot"),
        F.when(F.floor(F.col("vec_id") / 6) % 2 == 0, NATIONAL).otherwise(INTERNATIONAL).alias("scope"),
        F.concat(F.lit("headline "), F.col("vec_id")).alias("title"),
        F.concat(F.lit("site"), F.col("vec_id") % 7).alias("domain"),
        F.concat(F.lit("NATION_"), F.col("label")).alias("source_country"), subjects.alias("subjects"),
        softmax(raw).alias("p"), compound.alias("c"))
    c = F.col("c")
    pos, neg = F.greatest(c, F.lit(0.0)), F.greatest(-c, F.lit(0.0))
    lexicon = F.struct(neg.alias("neg"), F.round(F.lit(1.0) - pos - neg, 4).alias("neu"), pos.alias("pos"),
                       c.alias("compound"))
    p = F.col("p")
    classifier = F.struct(p[0].alias("neg"), p[1].alias("neu"), p[2].alias("pos"),
                          class_compound(p[0], p[1], p[2]).alias("compound"))
    return base.select("vec_id", "target_country", "slot", "scope", "title", "domain", "source_country", "subjects",
                       lexicon.alias(LEXICON), classifier.alias(CLASSIFIER))


def scores(spark: SparkSession, sf: str, wide: DataFrame | None = None) -> DataFrame:
    """The long fact: one row per headline and model."""
    wide = wide_scores(spark, sf) if wide is None else wide
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("s")) for m in (LEXICON, CLASSIFIER)])
    return (wide.withColumn("m", F.explode(models))
            .select(*[c for c in wide.columns if c not in (LEXICON, CLASSIFIER)], "m.model",
                    F.col("m.s.neg").alias("neg"), F.col("m.s.neu").alias("neu"),
                    F.col("m.s.pos").alias("positive"), F.col("m.s.compound").alias("compound"),
                    F.to_date("slot").alias("day")))


def placed_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The long fact with the position of each headline in its (country, slot, scope)."""
    placed = positions(wide_scores(spark, sf), ["target_country", "slot", "scope"], [F.col("vec_id")],
                       F.floor(F.col("vec_id") / 4096))
    return scores(spark, sf, placed)


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return tally_labels(scores(spark, sf), ["target_country", "slot", "scope", "model"])


def nested(spark: SparkSession, sf: str, chunk: int = CHUNK) -> DataFrame:
    return to_nested(placed_scores(spark, sf), chunk=chunk)


def nested_with_gaps(spark: SparkSession, sf: str, chunk: int = CHUNK) -> DataFrame:
    """Nested rows, plus a row with empty arrays for every nation that has no headlines."""
    full = nested(spark, sf, chunk)
    silent = (table(spark, sf, "nation").select(F.col("n_name").alias("target_country"))
              .join(wide_scores(spark, sf).select("target_country").distinct(), "target_country", "left_anti"))
    empty = silent.select(
        "target_country", ntz(FIRST_SLOT).alias("slot"), F.lit(0).alias("part"),
        F.lit(0).cast("bigint").alias("first_pos"),
        *[F.array().cast(full.schema[c].dataType).alias(c) for c in full.columns[4:]])
    return full.unionByName(empty)


def gappy_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One counts struct per document; NULL where the document has no label row."""
    joined = table(spark, sf, "documents").join(
        table(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    lab = (F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral"))
    return joined.select("lang", F.floor(F.col("n_chars") / 250).alias("size_class"),
                         F.when(F.col("known"), count_struct(lab)).alias("counts"))


def translations(spark: SparkSession, sf: str) -> DataFrame:
    """Translations exist for the labelled non-English documents; the others are failures."""
    done = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return (done.where(F.col("lang") != ENGLISH)
            .select(F.col("lang").alias("language"), F.col("text").alias("title")).distinct()
            .withColumn("title_en", F.concat(F.lit("[en] "), F.col("title"))))


def labelled_events(events: DataFrame) -> DataFrame:
    """Works on a table and on a stream of it."""
    return events.select(
        "event_id", "ts", "event_type",
        label(F.tanh((F.col("value") - 35.0) / 50.0)).alias("label"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON_WORDS, "token string, valence double")


def spoken_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents with frequent words replaced by words the context rules act on."""
    text = F.col("text")
    for old, new in RULE_WORDS:
        text = F.replace(text, F.lit(f" {old} "), F.lit(f" {new} "))
    return documents(spark, sf).select("doc_id", text.alias("text"))


RULE_WORDS = [
    ("of", "very"), ("and", "not"), ("in", "hardly"), ("no", "but"), ("thble", "never"), ("thtion", "so"),
    ("thing", "least"), ("to", "TO"), ("on", "VERY"), ("ist", "isn't"), ("los", "at"),
    ("that", "kind of"), ("by", "sort of"),
]


def handle_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents with a handle before and a link after them."""
    return documents(spark, sf).select(
        "doc_id", F.concat(F.lit("@"), F.col("source"), F.lit(" @ "), F.col("text"),
                           F.lit(" http://"), F.col("source"), F.lit(".example/"), F.col("doc_id")).alias("text"))


def host_of(url: str) -> Column:
    return F.regexp_extract(F.col(url), "^[a-z]+://([^/:?#]+)", 1)


def outlet_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each crawled page whole, with a record of its host before every paragraph and one of its site behind, then a
    denied one, a blank one, the end, and one more."""
    host, size = host_of("url"), F.length("html")
    opening = F.concat(
        F.lit(" Media Outlet "), host, F.lit(" Facebook Followers "), size.cast("string"),
        F.lit("KTwitter\nTwitter Followers "), F.col("page_id").cast("string"),
        F.lit("MInstagram Instagram Followers 7K Frequency "), (size % 30).cast("string"),
        F.lit(" posts/day Domain Authority "), (size % 100).cast("string"), F.lit(" <p>"))
    closing = F.concat(
        F.lit("</p> Media Outlet www."), host, F.lit(" Facebook Followers 12M Frequency 1 post/week Domain Authority "),
        ((size + F.col("page_id")) % 100).cast("string"), F.lit(" "))
    marked = F.replace(F.replace(F.col("html"), F.lit("</p>"), closing), F.lit("<p>"), opening)
    text = F.concat(
        marked, F.lit(" Media Outlet bbc.com Domain Authority 95 Media Outlet blank.example nothing here"),
        F.lit(" Media Outlet Contact us Media Outlet late.example Domain Authority 99 "))
    return table(spark, sf, "pages").select("page_id", text.alias("text"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Map regions: their name starts with the country's code."""
    return table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(code_of("n_nationkey"), F.lit("_"), F.col("r_name")).alias("region_name"))


def slot_key() -> Column:
    return hour_key(F.col("slot")).alias("slot_key")
