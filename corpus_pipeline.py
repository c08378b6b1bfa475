"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` names the stages in order; each takes (spark, docs, sf_dir) and returns a
table that is written and read again as the next one's docs. All but the last return the columns
of ``documents``; the last returns the pieces of packed sequences with their token ids.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from creditloom.llm import decontamination, language_id, packing, simhash_dedup, substring_dedup
from creditloom.llm.common import read, stage

#: Least share of a text's letters in its main language.
MIN_LANGUAGE_SCORE = 0.4
#: Near copies share 0.8 of their distinct five-word shingles, counted out for every candidate pair. Of 256
#: fingerprint bits texts of that similarity differ in 39 on average (standard deviation 5.7), at worst, with
#: five shingles, in 48; the radius for candidates misses 1 of 10,000 there and fewer than 1 of 1,000,000 from 10 shingles on.
NEAR = {"shingle": 5, "words": 4, "distinct": True, "radius": 72, "size_ratio": 0.8, "similarity": 0.8}

#: Bytes of an Arrow batch between Spark and its Python workers: whole rows cross in every stage, and a batch
#: stands in both at once. Rows are never cut; a longer one is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(step):
    """The stage ``step``, run with Arrow batches of ``BATCH_BYTES`` (or of fewer, where the session asks for that)."""

    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # The setting is read when the stage's table is written, so it stays in the session.
        now = spark.conf.get(_BATCH_SETTING).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
            spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
        return step(spark, docs, sf_dir)

    return run_step


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit(docs), MIN_LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs, **NEAR)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.strip_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    (name, _small_batches(step))
    for name, step in (
        ("language_id", identify_language),
        ("simhash_dedup", drop_near_copies),
        ("substring_dedup", strip_repeats),
        ("decontamination", drop_benchmark_leaks),
        ("packing", pack),
    )
]

#: Fingerprints, tilings and tokenisers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
