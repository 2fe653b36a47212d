"""The registered queries of the operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonewright.llm import edit_fingerprint, line_dedup, packing, piece_codec, quality, simhash, substring_index, token_counts, warc, wavelet
from tonewright.llm.common import documents, table
from tonewright.llm.oracles import LINES_SQL, QUALITY_SQL


def op1_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.edited_likeness(documents(table(spark, sf_dir, "documents")))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.digest_shards(spark, wavelet.write_shards(documents(table(spark, sf_dir, "documents"))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_table(token_counts.length_histogram(documents(table(spark, sf_dir, "documents"))))


def op4_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digest(table(spark, sf_dir, "pages"))


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(documents(table(spark, sf_dir, "documents")))


def op6_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.word_digest(documents(table(spark, sf_dir, "documents")))


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(table(spark, sf_dir, "documents")))


def op8_popcount_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(table(spark, sf_dir, "documents")))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(table(spark, sf_dir, "documents")))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(documents(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_edit_fingerprint": op1_edit_fingerprint,
    "op2_wavelet_shards": op2_wavelet_shards,
    "op3_token_counts": op3_token_counts,
    "op4_warc_captures": op4_warc_captures,
    "op5_line_winnowing": op5_line_winnowing,
    "op6_substring_index": op6_substring_index,
    "op7_cost_packing": op7_cost_packing,
    "op8_popcount_simhash": op8_popcount_simhash,
    "op9_line_quality": op9_line_quality,
    "op10_piece_codec": op10_piece_codec,
}

ORACLES = {
    "op5_line_winnowing": LINES_SQL,
    "op9_line_quality": QUALITY_SQL,
}
