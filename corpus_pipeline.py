"""From raw documents to token counts: quality, lines, near duplicates, mix, pieces."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from motionlake.llm import lines, mixing, overlap, pieces, quality, simhash  # noqa: E402
from motionlake.session import settle  # noqa: E402

#: Near duplicates: shingles of five words, similarity ``overlap.LEAST`` or more.
SHINGLE_WORDS = 5
#: Bits in which SimHash candidates differ at most.
RADIUS = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the posterior quality keep."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with runs of lines that occurred earlier cut out."""
    return lines.deduplicated_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    SimHash groups give the first candidates, minimum hashes those out of its reach; an
    exact comparison of the shingles decides about both.
    """
    return overlap.distinct_documents(docs, SHINGLE_WORDS, simhash.grouped(docs, SHINGLE_WORDS, RADIUS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; words-free documents are never taken."""
    return mixing.mixed_documents(docs)


def piece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix."""
    return pieces.coded_documents(docs, pieces.public_model())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("piece_codec", piece_codec),
]

#: Fingerprints and piece merging are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
