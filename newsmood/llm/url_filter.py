"""URL verdicts: host and path rules, then a blocked Bloom filter of listed URLs with an exact join behind it.

DataFrame functions only. The filter is a table of 256-bit blocks, one row each (block, w0..w3); a URL sets eight bits
in the one block that its hash names, so a look-up reads one row. Rows that the filter passes, listed URLs and a few
false positives, go on to an exact equi join with the list; all other rows never meet the list. The filter is sent to
every executor only while its size, computed from the counted list, is below ``BROADCAST_BYTES``; above it is joined
by block like any table. Spark splits a hot URL's partition at run time (adaptive skew join). The canonical list and the
probed rows are stored once, so the pages are read once.

Defined results: a null url, or one without ``://``, has an empty host and an empty path, fits no rule, is never
listed, and is allowed. Rows that repeat are judged one by one. An empty list allows what no rule blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.sources.shared import materialise

BLOCK_BITS, BITS_PER_URL, PROBES, WORDS = 256, 16, 8, 4
ROW_BYTES = 96  # of a block in a broadcast table, generously
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # host, path, verdict


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without tracking parameters; null without host.

    Scheme and fragment go; the path keeps its case.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.ltrim(F.regexp_replace(query, r"(^|&)(utm_[^&=]*|ref)=[^&]*", ""), F.lit("&"))
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    whole = F.concat(host, F.rtrim(path_of(url), F.lit("/")),
                     F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole)


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule[0]) | host.endswith(f".{rule[0]}")) & path.startswith(rule[1])


def longest_rule(host: Column, path: Column, rules: list[Rule], of: int | None = None) -> Column:
    """The longest rule that fits, as text, or with ``of`` one of its fields; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    each = [F.when(_fits(host, path, r), F.lit(r[0] + r[1] if of is None else r[of])) for r in ordered]
    return F.coalesce(*each) if each else F.lit(None).cast("string")


def _masks(url: Column) -> list[Column]:
    """The bits of a URL in its block, as four 64-bit words: eight positions from the bytes of one hash."""
    h = F.xxhash64(url, F.lit(1))
    at = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]
    # a shift of a 64-bit number counts modulo 64, so the position's upper two bits only choose the word
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), a.cast("int")) for a in at]
    none = F.lit(0).cast("long")
    return [reduce(Column.bitwiseOR, [F.when(F.shiftright(a, 6) == w, b).otherwise(none)
                                      for a, b in zip(at, bit, strict=True)]) for w in range(WORDS)]


def block_count(n_urls: int) -> int:
    return max(1, -(-n_urls * BITS_PER_URL // BLOCK_BITS))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the canonical URLs in column ``canon``."""
    marked = listed.select(_block(F.col("canon"), blocks).alias("block"),
                           *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("canon")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(rows: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (with ``canon``) and a boolean ``maybe``: false is certain."""
    table = bloom_blocks(listed, blocks)
    if blocks * ROW_BYTES <= BROADCAST_BYTES:
        table = F.broadcast(table)
    words = [F.coalesce(F.col(f"w{i}").bitwiseAND(m) == m, F.lit(False)) for i, m in enumerate(_masks(F.col("canon")))]
    return (rows.withColumn("block", _block(F.coalesce(F.col("canon"), F.lit("")), blocks)).join(table, "block", "left")
            .withColumn("maybe", F.col("canon").isNotNull() & reduce(Column.__and__, words))
            .drop("block", *[f"w{i}" for i in range(WORDS)]))


def judge(pages: DataFrame, listed_urls: DataFrame, rules: list[Rule], id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    ``listed_urls`` has a column ``url``; equal canonical forms are the same URL.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        canonical(url).alias("canon"))
    listed = materialise(listed_urls.select(canonical(F.col("url").cast("string")).alias("canon"))
                         .where(F.col("canon").isNotNull()).distinct(), "listed")
    probed = materialise(possible_hits(rows, listed, block_count(listed.count())), "probed")
    exact = (probed.where("maybe").join(listed.withColumn("listed", F.lit(True)), "canon", "left")
             .withColumn("listed", F.coalesce("listed", F.lit(False))))
    rest = probed.where(~F.col("maybe")).withColumn("listed", F.lit(False))
    host, path = F.col("host"), F.col("path")
    ruled = longest_rule(host, path, rules, 2)
    return (exact.unionByName(rest)
            .select("page_id", "host", "path", longest_rule(host, path, rules).alias("rule"),
                    F.coalesce(ruled, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed"))
