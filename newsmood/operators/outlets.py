"""Outlet records out of scraped directory pages.

A record is the 157 characters after each "Media Outlet" mark, read as space-separated tokens: the domain, then
values at fixed offsets after key words. A record that starts with "Contact" ends the page. With a page in a row everything
is array work within it: no shuffle until the final sort. ``extract_from_pieces`` is the same for pages of any size, whose
pieces are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood.constants import MIN_AUTHORITY, OUTLET_CHARS, OUTLET_DENY, OUTLET_END, OUTLET_MARK
from newsmood.functions.text import one_line, strip_network_name
from newsmood.operators.skew import positions
from newsmood.sources.shared import materialise


def _records(text: Column) -> Column:
    """The token arrays of all records of a page, in order.

    A record may run on over the next marks: as many pieces are put together again as the length can hold.
    """
    reach = OUTLET_CHARS // len(OUTLET_MARK) + 2
    pieces = F.transform(F.split(one_line(text), OUTLET_MARK), lambda p: F.substring(p, 1, OUTLET_CHARS + 1))
    return F.transform(
        F.array(pieces),
        lambda ps: F.transform(
            F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))),
            lambda _, i: F.split(
                F.substring(F.array_join(F.slice(ps, i + 2, F.lit(reach)), OUTLET_MARK), 2, OUTLET_CHARS),
                " ")))[0]


def _before_end(records: Column) -> Column:
    """Records before the end marker."""
    return F.transform(
        F.array(records),
        lambda rs: F.slice(rs, F.lit(1), _cut(rs)))[0]


def _cut(records: Column) -> Column:
    end = F.array_position(F.transform(records, lambda r: r[0]), F.lit(OUTLET_END))
    return F.when(end > 0, end - 1).otherwise(F.size(records)).cast("int")


def _last(tokens: Column, key: str) -> Column:
    """0-based index of the last token after the first that contains the key; NULL if there is none."""
    return F.array_max(F.transform(
        tokens, lambda t, i: F.when((i >= 1) & F.contains(t, F.lit(key)), i)))


def extract_outlets(pages: DataFrame, text: str, keys: list[str], min_authority: int = MIN_AUTHORITY,
                    deny: list[str] = OUTLET_DENY, ordered: bool = True) -> DataFrame:
    """(keys, record, domain, followers..., domain_auth) of the outlets with enough authority.

    Sorted by authority as a number, highest first.
    """
    per_page = pages.select(*keys, _records(F.col(text)).alias("records"))
    rows = per_page.select(*keys, F.posexplode(_before_end(F.col("records"))).alias("record", "t"))
    return _outlets(rows, keys, min_authority, deny, ordered)


CELL = 4096  # pieces of a page that are put in order together


def extract_from_pieces(pieces: DataFrame, min_authority: int = MIN_AUTHORITY, deny: list[str] = OUTLET_DENY,
                        ordered: bool = True) -> DataFrame:
    """The same rows by ``file`` out of pieces (file, number, value) between the marks, as ``readers.read_marked`` gives
    them.

    A record may run on over the next marks, so each cell of pieces borrows the first few of the next one. The end of a page
    is the smallest number of a record that starts with the end marker.
    """
    reach = OUTLET_CHARS // len(OUTLET_MARK) + 2
    # a mark may be broken over lines, which the reader does not see: pieces are split once more
    each = pieces.select("file", "number", F.posexplode(F.split(one_line(F.col("value")), OUTLET_MARK)).alias("sub", "piece"))
    each = each.withColumn("piece", F.substring("piece", 1, OUTLET_CHARS + 1))
    cells = each.withColumn("cell", F.floor(F.col("number") / CELL)).withColumn("own", F.lit(True))
    borrowed = (cells.where((F.col("number") % CELL < reach) & (F.col("cell") > 0))
                .withColumn("cell", F.col("cell") - 1).withColumn("own", F.lit(False)))
    on = Window.partitionBy("file", "cell").orderBy("number", "sub").rowsBetween(0, reach - 1)
    whole = F.array_join(F.collect_list("piece").over(on), OUTLET_MARK)
    tokens = F.split(F.substring(whole, 2, OUTLET_CHARS), " ")
    records = materialise(cells.unionByName(borrowed).withColumn("t", tokens)
                          .where(F.col("own") & ((F.col("number") > 0) | (F.col("sub") > 0)))
                          .select("file", "number", "sub", "t"), "records")
    ends = (records.where(F.col("t")[0] == OUTLET_END).groupBy("file")
            .agg(F.min(F.struct("number", "sub")).alias("end")))
    live = (records.join(ends, "file", "left")
            .where(F.col("end").isNull() | (F.struct("number", "sub") < F.col("end"))).drop("end"))
    numbered = positions(live, ["file"], [F.col("number"), F.col("sub")], F.floor(F.col("number") / CELL), "record")
    numbered = numbered.select("file", F.col("record").cast("int").alias("record"), "t")
    return _outlets(numbered, ["file"], min_authority, deny, ordered)


def _outlets(rows: DataFrame, keys: list[str], min_authority: int, deny: list[str], ordered: bool) -> DataFrame:
    """Outlets out of records (keys, record, t) of tokens."""
    at = rows.select(*keys, "record", "t", *[
        _last(F.col("t"), key).alias(key) for key in ("Facebook", "Twitter", "Instagram", "Frequency", "Domain")])

    def value(key: str, offset: int) -> Column:
        return F.coalesce(F.get(F.col("t"), F.col(key) + offset), F.lit(""))

    found = at.select(
        *keys, "record", F.col("t")[0].alias("domain"),
        strip_network_name(value("Facebook", 2)).alias("facebook_fol"),
        strip_network_name(value("Twitter", 2)).alias("twitter_fol"),
        strip_network_name(value("Instagram", 2)).alias("insta_fol"),
        F.concat(value("Frequency", 1), value("Frequency", 2)).alias("freq_post"),
        value("Domain", 2).alias("domain_auth"))
    kept = enough_authority(found, min_authority, deny)
    if not ordered:
        return kept
    # Spark computes what it sorts twice, once to find the ranges: from the exchange on, and not from the pages
    return kept.hint("rebalance").orderBy(F.col("domain_auth").try_cast("int").desc(), *keys, "record")


def enough_authority(outlets: DataFrame, min_authority: int = MIN_AUTHORITY,
                     deny: list[str] = OUTLET_DENY) -> DataFrame:
    """Outlets with at least the authority; a blank or unreadable one and denied domains are dropped."""
    return outlets.where((F.col("domain_auth").try_cast("int") >= min_authority) & ~F.col("domain").isin(*deny))
