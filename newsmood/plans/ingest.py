"""The load: articles -> pairs -> dedup -> relevance -> translation -> staged titles -> scores -> counts.

Results that are read more than once are written to the shared folder instead of being computed again: the articles
without repeats, the flagged ones (read by the fallback and completeness tests), the staged titles (read twice by the
ranking), the ranked ones and the texts that are shown (read by each model). Between the first and the last of them titles
are digests, so a text does not travel with each pair of an article and a country.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from newsmood.constants import CLASSIFIER, LEXICON, SLOT_HOURS, SUBJECTS
from newsmood.functions.text import is_english
from newsmood.functions.timing import slot_start
from newsmood.operators.articles import (GROUP, both_scopes, keep_relevant, scope_pairs, text_digest,
                                         translate_titles, with_relevance)
from newsmood.operators.dims import with_code
from newsmood.operators.labels import tally_labels
from newsmood.operators.lexicon import lexicon_score
from newsmood.operators.models import classify
from newsmood.operators.skew import first_per_group, positions, spread_join
from newsmood.sources.shared import materialise

HEADLINE_KEYS = ["target_country", "slot", "scope", "pos"]
TITLE_COLUMNS = [*HEADLINE_KEYS, "title", "domain", "source_country", "subjects"]
RANKED_COLUMNS = [*HEADLINE_KEYS, "digest", "domain", "source_country", "subjects"]
ARTICLE_COLUMNS = [*GROUP, "digest", "seen", "url", "title", "domain", "language", "source_country", "subjects"]
COUNT_KEYS = ["target_country", "slot", "scope", "model"]


def first_articles(articles: DataFrame, country_terms: dict[str, str], subjects: list[str] | None = SUBJECTS,
                   hours: int = SLOT_HOURS) -> DataFrame:
    """Articles(url, title, seen, domain, language, source_country) paired with the countries they name, in their
    slot, with the subjects they hold, deduplicated per (country, scope, slot). Articles may land any number of times,
    and urls may be null.

    Titles are told apart by ``digest``. A title travels with the first of its countries only, so there is one in each
    slot and scope of that country, and null beside the other countries.

    Every article stays that some request for the group returns, however many there are. Of equal titles the one seen
    first stays, then the smaller url: the order in which requests happen to be answered is not kept.
    """
    known = articles.withColumn("digest", text_digest(F.col("title")))
    pairs = (scope_pairs(known, country_terms, subjects, by=["url"], once=True)
             .withColumn("slot", slot_start(F.col("seen"), hours)))
    return first_per_group(pairs.select(ARTICLE_COLUMNS), [*GROUP, "digest"], [F.col("seen"), F.col("url")])


def flag_articles(articles: DataFrame, country_terms: dict[str, str], codes: DataFrame, relevant: DataFrame,
                  subjects: list[str] | None = SUBJECTS, hours: int = SLOT_HOURS) -> DataFrame:
    """``first_articles`` with the relevance flag."""
    return with_flags(first_articles(articles, country_terms, subjects, hours), codes, relevant)


def with_flags(unique: DataFrame, codes: DataFrame, relevant: DataFrame) -> DataFrame:
    """Adds the code of the target country, and whether the article's domain matters for it."""
    return with_relevance(with_code(unique, codes, "target_country", "target_code"), relevant, by=["url"])


def write_counted(flagged: DataFrame, path: str, groups: list[tuple[str, str]]) -> DataFrame:
    """Writes flagged articles and counts, in the same pass, those kept and removed of each (country, scope) in
    ``groups``: (target_country, scope, kind, n) of the groups that have any."""
    counts = []
    for i, (country, scope) in enumerate(groups):
        here = (F.col("target_country") == country) & (F.col("scope") == scope)
        counts += [F.count_if(here & F.col("relevant")).alias(f"kept{i}"),
                   F.count_if(here & ~F.col("relevant")).alias(f"removed{i}")]
    seen = Observation()
    flagged.observe(seen, *counts).write.parquet(path)
    found = seen.get
    rows = [(*group, kind, found[f"{kind}{i}"]) for i, group in enumerate(groups) for kind in ("kept", "removed")
            if found[f"kept{i}"] + found[f"removed{i}"]]
    return flagged.sparkSession.createDataFrame(rows, "target_country string, scope string, kind string, n bigint")


def select_titles(flagged: DataFrame) -> DataFrame:
    """Relevant articles of complete (country, slot)s.

    The fallback keeps every group that has articles, so completeness can be read off the flagged table.
    """
    slot_keys = ["target_country", "slot"]
    kept = keep_relevant(flagged, GROUP, by=["url"])
    return spread_join(kept, both_scopes(flagged, slot_keys), slot_keys, "left_semi", by=["url"])


def translate_digests(titles: DataFrame, texts: DataFrame, translations: DataFrame | None, translator: Callable | None,
                      english: str) -> tuple[DataFrame, DataFrame]:
    """As ``translate_titles``, on the digests of titles: the titles with the digest of their translation, failures
    dropped, and the translations (digest, title). A translator is asked once for each title of a language."""
    if translations is not None and translator is not None:
        raise ValueError("give either a translations table or a translator")
    native = is_english(F.col("language"), english)
    if translations is not None:
        done = translations.where(~native).select("language", text_digest(F.col("title")).alias("digest"), "title_en")
    else:
        asked = titles.where(~native).select("language", "digest").distinct().join(texts, "digest")
        done = translate_titles(asked, translator=translator, english=english).withColumnRenamed("title", "title_en")
    done = materialise(done.where(F.col("title_en").isNotNull()).select(
        "language", "digest", text_digest(F.col("title_en")).alias("digest_en"), "title_en"), "translated")
    if translations is not None:
        joined = spread_join(titles, done.drop("title_en"), ["language", "digest"], "left", by=["url"], salts=8)
    else:  # a translator may be asked without a language
        found = done.select(F.col("language").alias("__language"), F.col("digest").alias("__digest"), "digest_en")
        joined = titles.join(found, F.col("language").eqNullSafe(F.col("__language"))
                             & (F.col("digest") == F.col("__digest")), "left").drop("__language", "__digest")
    shown = joined.where(native | F.col("digest_en").isNotNull()).withColumn(
        "digest", F.when(native, F.col("digest")).otherwise(F.col("digest_en"))).drop("digest_en")
    return shown, done.select(F.col("digest_en").alias("digest"), F.col("title_en").alias("title"))


def place_titles(unique: DataFrame, codes: DataFrame, relevant: DataFrame, translations: DataFrame | None = None,
                 translator: Callable | None = None, english: str = "English") -> tuple[DataFrame, DataFrame]:
    """Stored ``first_articles`` -> the ranked headlines by ``digest``, and each of their texts once: (digest, title).

    Flags, selection, translation and ranks go by digest; texts are only read to store those that are shown.
    """
    flagged = materialise(with_flags(unique.drop("title"), codes, relevant), "flagged")
    texts = unique.where(F.col("title").isNotNull()).select("digest", "title")
    titles = select_titles(flagged)
    if translations is not None or translator is not None:
        given = texts.dropDuplicates(["digest"]) if translator is not None else texts
        titles, translated = translate_digests(titles, given, translations, translator, english)
        texts = texts.unionByName(translated)
    ranked = materialise(rank_titles(materialise(titles, "titles"), RANKED_COLUMNS), "ranked")
    shown = materialise(ranked.select("digest").distinct(), "shown")
    return ranked, materialise(texts.join(shown, "digest", "left_semi").dropDuplicates(["digest"]), "texts")


def rank_titles(titles: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Position of each title in its (country, scope, slot), by the minute of arrival and then by a hash of the url.

    The bucket of the ranking is the minute and the leading bits of the hash, which never decrease along that order:
    even a minute that holds most of the rows is ranked in 32 pieces.
    """
    minute = F.date_trunc("minute", F.col("seen")).cast("timestamp_ntz")
    mixed = F.xxhash64("url")
    bucket = F.struct(minute.alias("minute"), F.shiftright(mixed, 59).alias("piece"))
    return positions(titles, GROUP, [minute, mixed, F.col("url")], bucket).select(columns or TITLE_COLUMNS)


def score_titles(ranked: DataFrame, texts: DataFrame, lexicon: DataFrame | None = None,
                 make_scorer: Callable | None = None) -> DataFrame:
    """Ranked headlines and their texts by ``digest`` -> one row per headline and model given, without the title.

    Each text is scored once, however many headlines it is; only its scores go to them.
    """
    scores = ["neg", "neu", "positive", "compound"]
    parts = []
    if lexicon is not None:
        parts.append(lexicon_score(texts, lexicon, "title", ["digest"]).withColumn("model", F.lit(LEXICON)))
    if make_scorer is not None:
        parts.append(classify(texts, make_scorer).withColumn("model", F.lit(CLASSIFIER)))
    if not parts:
        raise ValueError("give a lexicon, a classifier or both")
    long = [p.select("digest", "model", *scores) for p in parts]
    scored = long[0] if len(long) == 1 else long[0].unionByName(long[1])
    return (ranked.join(scored, "digest").select(*RANKED_COLUMNS, "model", *scores)
            .withColumn("day", F.to_date("slot")))


def with_texts(scored: DataFrame, texts: DataFrame) -> DataFrame:
    """The long fact: scored headlines with their titles."""
    others = [c for c in scored.columns if c not in RANKED_COLUMNS]
    return scored.join(texts, "digest").select(*TITLE_COLUMNS, *others)


def count_labels(fact: DataFrame, by_subject: bool = False) -> DataFrame:
    """The counts rollup of the fact; by subject, a headline counts for each of its subjects."""
    if by_subject:
        return tally_labels(fact.withColumn("subject", F.explode("subjects")),
                            [*COUNT_KEYS, "subject"]).withColumn("day", F.to_date("slot"))
    return tally_labels(fact, COUNT_KEYS).withColumn("day", F.to_date("slot"))


def load(articles: DataFrame, country_terms: dict[str, str], codes: DataFrame, relevant: DataFrame,
         lexicon: DataFrame | None = None, make_scorer: Callable | None = None,
         translations: DataFrame | None = None, translator: Callable | None = None,
         subjects: list[str] | None = SUBJECTS, hours: int = SLOT_HOURS, english: str = "English") -> DataFrame:
    """Articles -> scored fact; the whole load with its stored intermediate tables.

    A lexicon scores English. Titles in other languages are scored as they are unless there are translations or a
    translator. With ``hours=24`` slots are days, as the daily load has them.
    """
    unique = materialise(first_articles(articles, country_terms, subjects, hours), "unique")
    ranked, texts = place_titles(unique, codes, relevant, translations, translator, english)
    return with_texts(score_titles(ranked, texts, lexicon, make_scorer), texts)
