"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motionlake.catalog.registry import Entry
from motionlake.llm import blockmax, caps, lines, mixing, negatives, pages, phrases, pieces, quality, simhash, suffixes, toxicity, whitening
from motionlake.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(read(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), size=3, radius=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).drop("source", "copies")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.coded_documents(read(spark, sf_dir, "documents"), pieces.public_model())


def op10_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.nearest(read(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(read(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def entries() -> dict[str, Entry]:
    return {
        "op1_quality_rules": Entry(op1_quality_rules, quality.oracle()),
        "op2_suffix_dedup": Entry(op2_suffix_dedup, None),
        "op3_page_text": Entry(op3_page_text, None),
        "op4_toxicity": Entry(op4_toxicity, None),
        "op5_simhash": Entry(op5_simhash, None),
        "op6_line_dedup": Entry(op6_line_dedup, lines.oracle()),
        "op7_phrase_dedup": Entry(op7_phrase_dedup, None),
        "op8_source_mixing": Entry(op8_source_mixing, mixing.oracle()),
        "op9_piece_codec": Entry(op9_piece_codec, None),
        "op10_embedding_caps": Entry(op10_embedding_caps, None),
        "op11_exact_topk": Entry(op11_exact_topk, blockmax.oracle()),
        "op12_hard_negatives": Entry(op12_hard_negatives, negatives.oracle()),
        "op13_whitening": Entry(op13_whitening, None),
    }
