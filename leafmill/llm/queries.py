"""The queries of the corpus operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bloom, decontaminate, frames, pieces, pii, repetition, secrets, simhash, toxicity, warc

#: Hosts whose pages the URL filter lists, with all hosts below them.
LISTED_HOSTS = ["casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "ads-track.example.com", "spam-farm.example.com", "spam-farm.example.org", "adult-x.example.net"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture index of all pages. They have no capture times; these are made from page_id."""
    seconds = 1_600_000_000 + F.pmod(F.col("page_id") * 7919, F.lit(100_000_000))
    return warc.capture_index(_table(spark, sf_dir, "pages").withColumn("timestamp", F.timestamp_seconds(seconds)))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every document."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data, and how many it holds."""
    return pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verbatim match of a test item in a document."""
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's repetition measures and verdict."""
    return repetition.repetition(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has near duplicates, with the one that stays of its group."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ids of every document lie in the shards that it writes."""
    return frames.write(_table(spark, sf_dir, "documents"))[1]


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL key, and whether it is listed: by its host, or as the key of a page whose id is divisible by 50."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    keys = pages.where("page_id % 50 = 0").select(bloom.url_key("url").alias("url_key"))
    return bloom.filter_urls(pages, keys, LISTED_HOSTS)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that counts as toxic, with the probabilities of all categories."""
    return toxicity.toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": op1_warc_index,
    "op2_secrets": op2_secrets,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_decontaminate": op4_decontaminate,
    "op5_repetition": op5_repetition,
    "op6_simhash": op6_simhash,
    "op7_token_frames": op7_token_frames,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
}

_HOSTS = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED_HOSTS)

ORACLE_SQL: dict[str, str] = {
    "op1_warc_index": r"""
        WITH bare AS (
            SELECT page_id, url, html, regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '') AS bare FROM pages),
        parts AS (
            SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*'), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
                regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                array_to_string(list_sort(string_split(regexp_extract(bare, '\?(.*)$', 1), '&')), '&') AS query FROM bare),
        keyed AS (
            SELECT page_id, url, CASE WHEN coalesce(length(bare), 0) = 0 THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS urlkey,
                make_timestamp((1600000000 + page_id * 7919 % 100000000) * 1000000) AS timestamp, sha1(html) AS digest, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM parts)
        SELECT row_number() OVER (ORDER BY urlkey, timestamp NULLS FIRST, page_id NULLS FIRST, digest NULLS FIRST) - 1 AS position,
            row_number() OVER (PARTITION BY urlkey ORDER BY timestamp NULLS FIRST, page_id NULLS FIRST, digest NULLS FIRST) AS capture, urlkey, timestamp, page_id, url, digest, n_bytes
        FROM keyed""",
    "op9_url_filter": rf"""
        WITH bare AS (
            SELECT page_id, url, regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '^[a-z][a-z0-9+.-]*://', '') AS bare FROM pages),
        keyed AS (
            SELECT page_id, url, nullif(regexp_replace(regexp_replace(regexp_replace(bare, '^([^/]*@)?(www\.|m\.)?', ''), '^([^/:]*):[0-9]*', '\1'), '/+$', ''), '') AS url_key FROM bare),
        hosts AS (SELECT *, regexp_extract(url_key, '^[^/]*') AS host FROM keyed)
        SELECT page_id, url, url_key, coalesce({_HOSTS}, false) OR coalesce(url_key IN (SELECT url_key FROM hosts WHERE page_id % 50 = 0 AND url_key IS NOT NULL), false) AS listed FROM hosts""",
}
