"""The registered queries of the operators: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.llm import (bpe, conversations, exact_dedup, near_dedup, neighbours, oracle, packing, parity_join,
                          quality, secrets, token_scan, toxicity, url_filter, whitening)
from newsmood.llm.common import table
from newsmood.sources.shared import fresh_path

RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"), keep="largest")


def op2_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.summary(table(spark, sf, "documents"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The list are the URLs whose MD5 begins with 0 or 1, in whatever form a page has them: neither rules nor hosts tell
    which they are."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    listed = pages.where(F.md5("url").rlike("^[01]")).select("url")
    return url_filter.judge(pages, listed, URL_RULES)


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"), "toxic", rest=2, parts=4)


def op6_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score(table(spark, sf, "documents"), table(spark, sf, "labels"), "quality", rest=0, parts=5)


END_OF_TEXT = 50256  # of both vocabulary files; fits 16 bits


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as flat files of 16-bit ids, then the lengths that the scan finds in them."""
    path = fresh_path(spark, "tokens")
    token_scan.write_flat(table(spark, sf, "documents"), path, public_tokenizers.path(VOCABULARY),
                          public_tokenizers.PATTERN, END_OF_TEXT)
    return (token_scan.document_lengths(spark, path, END_OF_TEXT)
            .withColumn("file", F.regexp_replace("file", r"^.*/part-(\d+)-[^/]*\.c(\d+)\.[^/]*$", "$1.$2")))


def op9_nearest(spark: SparkSession, sf: str) -> DataFrame:
    good = neighbours.usable(table(spark, sf, "embeddings"))
    return neighbours.search(good, F.col("vec_id") % 100 == 0, k=10)


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op12_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf, "documents"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return conversations.report(rows, conversations.damaged(rows))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_nearest": op9_nearest,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_whitening": op11_whitening,
    "op12_ngram_jaccard": op12_ngram_jaccard,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE = {
    "op6_near_dedup": oracle.near_duplicates(near_dedup.WORDS, near_dedup.PERCENT),
    "op12_ngram_jaccard": oracle.components(parity_join.WORDS, parity_join.PERCENT),
    "op13_conversation_repair": oracle.CONVERSATIONS,
    "op1_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                   'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_url_filter": r"""
        WITH p AS (
            SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                   ltrim(regexp_replace(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1),
                                        '(^|&)(utm_[^&=]*|ref)=[^&]*', '', 'g'), '&') AS query
            FROM pages),
        c AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN
                  regexp_replace(host, '^www\.', '') || rtrim(path, '/')
                  || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canon FROM p),
        r AS (SELECT *, CASE
                  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%'
                      THEN 'www.example.com/en/'
                  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
                  coalesce(canon IN (SELECT canon FROM c WHERE regexp_matches(md5(url), '^[01]')
                                     AND canon IS NOT NULL), false) AS listed FROM c)
        SELECT page_id, host, path, rule, CASE
                   WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                   WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r""",
}
