"""Articles: pairing with target countries, scopes, slots, deduplication, relevance, translation, completeness."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.constants import INTERNATIONAL, NATIONAL, SLOT_HOURS
from newsmood.functions.text import is_english, translator_language
from newsmood.functions.timing import in_slot
from newsmood.operators.domains import is_relevant
from newsmood.operators.skew import SALTS, first_per_group, spread_join, top_n_per_group
from newsmood.sources.shared import materialise

GROUP = ["target_country", "scope", "slot"]
WORD_BREAK = r"[^\p{L}\p{N}]+"


def scope_of(source: Column, target: Column) -> Column:
    return F.when(source == target, NATIONAL).otherwise(INTERNATIONAL)


def title_words(text: Column) -> Column:
    """The distinct words of a text in lower case: its runs of letters and digits."""
    return F.array_distinct(F.split(F.lower(text), WORD_BREAK))


def term_words(spark: SparkSession, terms: dict[str, str]) -> DataFrame:
    """(name, word, n): the words of each name's term, and how many there are."""
    rows = []
    for name, term in terms.items():
        words = sorted(set(re.findall(r"[^\W_]+", term.lower())))
        rows += [(name, word, len(words)) for word in words]
    return spark.createDataFrame(rows, "name string, word string, n int")


TEXT_KEY = ["__digest", "__by"]


def with_text_key(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Adds ``TEXT_KEY``: a digest of the text, and a hash of ``by`` so that copies of a hot text have many keys.

    What a text holds depends on nothing but the text, so rows with equal keys may share what is found. No part is
    null where the text is not.
    """
    return df.withColumn("__digest", F.sha2(F.col(text), 256)).withColumn("__by", F.xxhash64(*by))


def matched_terms(keyed: DataFrame, terms: DataFrame, text: str = "title") -> DataFrame:
    """(TEXT_KEY, kind, name) of the terms all of whose words are among the words of the text.

    ``terms``: kind, name, word, n. An equi join of words with the terms' words; a list of any length is a table like
    any other, which Spark broadcasts on its size. Distinct words are counted, so rows that repeat do not add up.
    """
    words = keyed.select(*TEXT_KEY, F.explode(title_words(F.col(text))).alias("word"))
    return (words.join(terms, "word").groupBy(*TEXT_KEY, "kind", "name")
            .agg(F.size(F.collect_set("word")).alias("found"), F.max("n").alias("n"))
            .where(F.col("found") == F.col("n")).drop("found", "n"))


def _listed(terms: dict[str, str]) -> list[tuple[str, list[str]]]:
    """The names in order with the words of their terms. Terms without a word are never held."""
    split = [(name, sorted(set(re.findall(r"[^\W_]+", term.lower())))) for name, term in sorted(terms.items())]
    return [(name, parts) for name, parts in split if parts]


def _held(words: Column, country_terms: dict[str, str], subjects: list[str] | None) -> Column:
    """struct<countries, subjects>: the names of the terms all of whose words are among ``words``; no countries where
    subjects are asked for and none is held."""
    countries, wanted = _listed(country_terms), _listed({s: s for s in subjects or []})
    every = sorted({w for _, parts in countries + wanted for w in parts})

    def names(listed: list[tuple[str, list[str]]], known: Column) -> Column:
        if not listed:
            return F.array().cast("array<string>")
        table = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, parts)).alias("words"))
                          for name, parts in listed])
        held = F.filter(table, lambda t: F.size(F.array_except(t["words"], known)) == 0)
        return F.transform(held, lambda t: t["name"])

    def both(found: Column) -> Column:
        held = F.when(F.lit(subjects is None) | (F.size(found["subjects"]) > 0), found["countries"])
        return F.struct(held.alias("countries"), found["subjects"].alias("subjects"))

    # arrays of one element, so that the words are looked at once, and not for each term or each use of what was found
    known = F.array(F.array_intersect(words, F.array(*map(F.lit, every)).cast("array<string>")))
    found = F.transform(known, lambda k: F.struct(names(countries, k).alias("countries"), names(wanted, k).alias("subjects")))
    return F.transform(found, both)[0]


#: Up to so many terms are matched within a row, as literals of the plan; more are a table that words are joined with.
INLINE_TERMS = 1_000


def text_digest(text: Column) -> Column:
    """The 32 bytes that a text is known by where it does not travel itself."""
    return F.unhex(F.sha2(text, 256))


def scope_pairs(df: DataFrame, country_terms: dict[str, str], subjects: list[str] | None, by: list[str],
                text: str = "title", source: str = "source_country", once: bool = False) -> DataFrame:
    """(article, target country) pairs for the countries a text names, with the scope of each pair.

    ``country_terms`` maps a country to the term that names it; ``by`` are columns that tell copies of a text apart.
    Every row is matched by its own text, also where ``by`` repeats or is null. With ``subjects`` a text must hold one
    of them as well; those it holds are in ``subjects``, in order. Only the countries found are exploded, so there is
    never a product of articles and countries. Within ``INLINE_TERMS`` no text leaves its task, and the same plan works
    on a stream; the rows are the same either way. With ``once`` the text stays with the first of an article's countries
    and is null in its other pairs; which country that is depends on the text alone.
    """
    if len(country_terms) + len(subjects or []) > INLINE_TERMS:
        found = _pairs_by_join(df, country_terms, subjects, by, text)
    else:
        held = df.withColumn("__held", _held(title_words(F.col(text)), country_terms, subjects))
        others = [c for c in df.columns if c != "subjects"]
        found = held.select(*others, F.col("__held.subjects").alias("subjects"),
                            F.col("__held.countries").alias("__countries"))
    # The outer form, and a condition on what it gives: Spark would evaluate one on the arrays a second time before it.
    if once:
        pairs = found.select("*", F.posexplode_outer("__countries").alias("__at", "target_country"))
        pairs = pairs.withColumn(text, F.when(F.col("__at") == 0, F.col(text))).drop("__at")
    else:
        pairs = found.withColumn("target_country", F.explode_outer("__countries"))
    return (pairs.where("target_country IS NOT NULL").drop("__countries")
            .withColumn("scope", scope_of(F.col(source), F.col("target_country"))))


def _pairs_by_join(df: DataFrame, country_terms: dict[str, str], subjects: list[str] | None, by: list[str],
                   text: str) -> DataFrame:
    """The rows that hold a country, and a subject if there are any, with ``__countries`` and ``subjects``."""
    spark = df.sparkSession
    terms = term_words(spark, country_terms).withColumn("kind", F.lit("country"))
    if subjects is not None:
        terms = terms.unionByName(term_words(spark, {x: x for x in subjects}).withColumn("kind", F.lit("subject")))
    terms = materialise(terms, "terms")  # a stored table, whose size is known when the join is planned
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name"))))
    keyed = with_text_key(df, by, text)
    found = matched_terms(keyed, terms, text).groupBy(*TEXT_KEY).agg(
        names("country").alias("__countries"), names("subject").alias("subjects"))
    found = found.where(F.size("__countries") > 0)
    if subjects is not None:
        found = found.where(F.size("subjects") > 0)
    return keyed.join(found, TEXT_KEY).drop(*TEXT_KEY)


def seen_in_slot(df: DataFrame, slot_end: Column, seen: str = "seen", hours: int = SLOT_HOURS) -> DataFrame:
    return df.where(in_slot(F.col(seen), slot_end, hours))


def dedup_titles(df: DataFrame, keys: list[str], order: list[Column], title: str = "title") -> DataFrame:
    """The first article of each title within the keys. Titles are told apart by a digest of fixed width, so the
    shuffle and the sorts do not carry the texts as keys."""
    digest = df.withColumn("__digest", F.sha2(F.col(title), 256))
    return first_per_group(digest, [*keys, "__digest"], order).drop("__digest")


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column], by: list[str], n: int,
                  salts: int = SALTS) -> DataFrame:
    """At most ``n`` articles per group, as one request to the service returns: a top-n."""
    return top_n_per_group(df, keys, order, n, by, salts)


def with_relevance(df: DataFrame, relevant: DataFrame, by: list[str], target_code: str = "target_code",
                   domain: str = "domain", scope: str = "scope", salts: int = SALTS) -> DataFrame:
    """Adds ``relevant``: the article's domain matters for the target in this scope.

    One equi join on the domain against one row per domain; one domain may own a large share of the articles.
    """
    codes = relevant.select(F.col("domain").alias(domain), F.col("codes").alias("__codes"))
    joined = spread_join(df, codes, [domain], "left", by, salts)
    flag = is_relevant(F.col("__codes"), F.col(target_code), F.col(scope) == INTERNATIONAL)
    return joined.withColumn("relevant", flag).drop("__codes")


def keep_relevant(flagged: DataFrame, keys: list[str], by: list[str], salts: int = SALTS) -> DataFrame:
    """Relevant articles; where a group has none, all of the group's articles.

    The groups without any are found by a map-side aggregate and joined back, so no group is ever brought into
    one task as a window over it would.
    """
    without = (flagged.groupBy(*keys).agg(F.bool_or("relevant").alias("__any"))
               .where(~F.col("__any")).select(*keys, F.lit(True).alias("__none")))
    return (spread_join(flagged, without, keys, "left", by, salts)
            .where(F.col("relevant") | F.col("__none").isNotNull()).drop("__none"))


def relevance_counters(flagged: DataFrame, keys: list[str]) -> DataFrame:
    return flagged.groupBy(*keys).agg(
        F.count_if(F.col("relevant")).alias("kept"), F.count_if(~F.col("relevant")).alias("removed"))


def both_scopes(df: DataFrame, keys: list[str], scope: str = "scope") -> DataFrame:
    """Keys that have rows in both scopes."""
    return (df.groupBy(*keys)
            .agg(F.bool_or(F.col(scope) == NATIONAL).alias("__nat"),
                 F.bool_or(F.col(scope) == INTERNATIONAL).alias("__int"))
            .where(F.col("__nat") & F.col("__int")).select(*keys))


def scope_totals(df: DataFrame, keys: list[str], scope: str = "scope") -> DataFrame:
    """Rows per key, of the keys that have rows in both scopes, in one map-side aggregate."""
    return (df.groupBy(*keys)
            .agg(F.bool_or(F.col(scope) == NATIONAL).alias("__nat"),
                 F.bool_or(F.col(scope) == INTERNATIONAL).alias("__int"), F.count(F.lit(1)).alias("articles"))
            .where(F.col("__nat") & F.col("__int")).drop("__nat", "__int"))


def complete_only(df: DataFrame, keys: list[str], by: list[str], salts: int = SALTS) -> DataFrame:
    """Rows of keys that have both scopes."""
    return spread_join(df, both_scopes(df, keys), keys, "left_semi", by, salts)


def pending(grid: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the grid that are not stored yet. Both sides hold a key once or a few times."""
    return grid.join(stored.select(*keys).distinct(), keys, "left_anti")


def language_volume(df: DataFrame, language: str = "language", text: str = "title") -> DataFrame:
    """Titles and characters per language."""
    return df.groupBy(translator_language(F.col(language)).alias("language")).agg(
        F.count(F.lit(1)).alias("titles"), F.sum(F.length(text)).cast("bigint").alias("chars"))


Translator = Callable[[str, list[str]], list]


def translate_titles(df: DataFrame, translations: DataFrame | None = None, translator: Translator | None = None,
                     language: str = "language", title: str = "title", english: str = "English",
                     by: list[str] | None = None, salts: int = 8) -> DataFrame:
    """English titles as they are, others translated, failures dropped; title and article stay one row.

    Either ``translations(language, title, title_en)`` with one row per title, or ``translator(language, titles)``
    returning one translation or ``None``/``False`` per title. The join is on a digest of the title, and with ``by``
    (columns that tell copies of a title apart) salted, for titles that very many articles share.
    """
    if (translations is None) == (translator is None):
        raise ValueError("give either a translations table or a translator")
    if translator is not None:
        return _translate_batches(df, translator, language, title, english)
    lookup = (translations.where(~is_english(F.col("language"), english))
              .select(F.col("language").alias(language), F.sha2(F.col("title"), 256).alias("__digest"), "title_en"))
    marked = df.withColumn("__digest", F.sha2(F.col(title), 256))
    joined = spread_join(marked, lookup, [language, "__digest"], "left", by or [], salts if by else 1)
    native = is_english(F.col(language), english)
    return (joined.where(native | F.col("title_en").isNotNull())
            .withColumn(title, F.when(native, F.col(title)).otherwise(F.col("title_en")))
            .drop("title_en", "__digest"))


def _translate_batches(df: DataFrame, translator: Translator, language: str, title: str,
                       english: str) -> DataFrame:
    """One translator call per language and Arrow batch. Rows stay in their partition: sorting within it groups
    the languages, so a hot language is as spread out as its rows are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for name, part in batch.groupby(language, dropna=False, sort=False):
                if name != english:
                    done = pd.Series(translator(name, part[title].tolist()), index=part.index, dtype=object)
                    part = part.assign(**{title: done})[done.map(lambda t: isinstance(t, str))]
                kept.append(part)
            if kept:
                yield pd.concat(kept)

    return df.sortWithinPartitions(language).mapInPandas(run, df.schema)
