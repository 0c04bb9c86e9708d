"""The registered queries of the training-data operators, and their oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripewise.llm import decontam, html_wrappers, imatch, langid_crf, lm_scoring, mixing, quality, simhash, warc_zstd
from stripewise.llm import token_counts as counting
from stripewise.llm.common import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with a cache that is new to this run."""
    docs = _read(spark, sf_dir, "documents")
    return counting.token_counts(docs, scratch_path(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words at weights 3, 1, 2, no source above twice its size."""
    return mixing.mix(_read(spark, sf_dir, "documents"))[0]


@_query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents: three-word shingles, links at two bits or fewer."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, and the archives read back."""
    path = scratch_path(spark, "warc")
    warc_zstd.write(_read(spark, sf_dir, "pages"), path)
    return warc_zstd.read(spark.read.parquet(path), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item; clean documents aren't listed."""
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query
def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts."""
    return imatch.match(_read(spark, sf_dir, "documents"))


@_query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages by wrappers of their hosts."""
    return html_wrappers.main_texts(_read(spark, sf_dir, "pages"))


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents by a classifier of labels whose crc32 modulo 5 isn't 0."""
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by a CRF of those whose crc32 modulo 4 isn't 2."""
    return langid_crf.languages(_read(spark, sf_dir, "documents"))


@_query
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of word pairs learned from those whose crc32 modulo 7 isn't 2."""
    return lm_scoring.score_texts(_read(spark, sf_dir, "documents"))
