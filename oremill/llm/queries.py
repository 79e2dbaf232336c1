"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, exact_dedup, fingerprint, minhash, packing, quality, sentencepiece_codec, sharding, token_counts, toxicity, url_filter


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(base.read(spark, sf_dir, "documents"))


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: those of ids whose crc32, modulo 3, isn't 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, learnable(base.read(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.score(docs, model, at=0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(base.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(base.read(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(base.read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(base.read(spark, sf_dir, "documents"), shards=8)


#: The rules of the query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A url is labelled by the quality of the document whose number its path ends with."""
    pages = base.read(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("url", "/(\\d+)[^/]*/?$", 1).try_cast("long")
    labels = base.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), (F.col("quality") == 0).cast("int").alias("y"))
    labelled = pages.select("url", number.alias("number")).join(labels, "number").select("url", "y")
    return url_filter.judge(pages, labelled, URL_RULES)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    viewed = quality.views(base.read(spark, sf_dir, "documents"), ["doc_id"])
    return quality.score(viewed, quality.fit(viewed, base.read(spark, sf_dir, "labels")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(base.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(base.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_sentencepiece, op4_minhash, op5_fingerprints, op6_sharding, op7_url_filter, op8_quality, op9_best_fit_packing, op10_token_counts)}

ORACLES: dict[str, str] = {"op1_exact_dedup": exact_dedup.ORACLE}
