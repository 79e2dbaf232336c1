"""The corpus pipeline: documents in, training sequences out.

Quality classifier, toxicity filter, exact deduplication, near-duplicate removal, best-fit packing. Each stage works on
all that its predecessor kept; all but the last return the columns of documents.

A stage deletes the scratch tables of the stage before it, but for those that its own input reads: a stage's result is to be
written, or passed on as it is, before the same thread calls the next stage.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from oremill.llm import base, exact_dedup, minhash, packing, quality, queries, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good (a chance of 0.5 or more)."""
    return quality.keep_good(docs, base.read(spark, sf_dir, "labels"), at=0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.7."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, queries.learnable(base.read(spark, sf_dir, "labels"))), at=0.7)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


_LEFT = threading.local()


def _freeing(i: int, stage: Callable) -> Callable:
    """The i-th stage, after deleting what the stage before it has left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.__dict__.setdefault("tables", {})  # by stage
        kept = base.discard(left.pop(i - 1, []), docs)
        with base.noted() as made:
            out = stage(spark, docs, sf_dir)
        left[i] = kept + made
        return out

    return run


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]
STAGES = [(name, _freeing(i, stage)) for i, (name, stage) in enumerate(STAGES)]

#: Classifiers, sketches and tokenizers can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to documents, each written to the shared folder and read again."""
    docs = base.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = base.store(docs, name)
            base.drop(before)
    return docs
