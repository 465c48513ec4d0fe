"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmood.constants import ENGLISH, LANGUAGE_NAMES

TERM_SEPARATOR = " OR "


def mask_handles(text: Column) -> Column:
    """``@name`` becomes ``@user`` and a link becomes ``http``, token by space-separated token."""
    return F.array_join(
        F.transform(
            F.split(text, " "),
            lambda t: F.when(t.startswith("@") & (F.length(t) > 1), "@user")
                       .when(t.startswith("http"), "http")
                       .otherwise(t)),
        " ")


def squeeze(text: Column) -> Column:
    """Text without any whitespace."""
    return F.regexp_replace(text, r"\s+", "")


def safe_name(text: Column) -> Column:
    return F.translate(text, ":", "_")


def split_terms(text: Column) -> Column:
    return F.split(text, TERM_SEPARATOR)


def join_terms(country: Column, subjects: list[str]) -> Column:
    """``"<country> <subject>"`` for every subject, OR-separated."""
    return F.array_join(
        F.transform(F.array(*[F.lit(s) for s in subjects]), lambda s: F.concat_ws(" ", country, s)),
        TERM_SEPARATOR)


def with_scope_prefix(country: Column, international: Column) -> Column:
    return F.when(international, F.concat(F.lit("-"), country)).otherwise(country)


def strip_scope_prefix(country: Column) -> Column:
    return F.when(country.startswith("-"), F.substring(country, 2, 1 << 30)).otherwise(country)


def translator_language(language: Column) -> Column:
    """Language name as translators spell it, lower case."""
    renamed = F.coalesce(
        *[F.when(language == name, spelled) for name, spelled in LANGUAGE_NAMES.items()], language)
    return F.lower(renamed)


def is_english(language: Column, english: str = ENGLISH) -> Column:
    return language.eqNullSafe(english)


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "\n", " ")


def strip_network_name(text: Column) -> Column:
    """Cuts the length of the social network's name off the end of a value that contains the name."""
    def cut(name: str) -> Column:
        return F.substring(text, F.lit(1), F.length(text) - F.lit(len(name)))

    return (F.when(F.contains(text, F.lit("Twitter")), cut("Twitter"))
            .when(F.contains(text, F.lit("Instagram")), cut("Instagram"))
            .otherwise(text))


def words(text: Column) -> Column:
    """Lower-case runs of letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def country_prefix(name: Column) -> Column:
    """The two-letter country code a region name starts with."""
    return F.left(name, F.lit(2))


def file_country_code(file_name: Column) -> Column:
    """Country code in characters 20-21 of a rank file's name."""
    return F.substring(file_name, 20, 2)
