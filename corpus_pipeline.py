"""The corpus pipeline: quality rules, line dedup, near dedup, substring dedup, packing.

Each stage takes what the stage before has kept, as a Parquet table with the columns of
``documents``, and returns such a table; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonewright.llm import line_dedup, packing, quality, simhash, substring_index
from tonewright.llm.common import documents, only, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    return quality.clean_documents(only(docs, *COLUMNS))


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of three lines go; documents that have nothing left go too."""
    return line_dedup.cut_documents(only(docs, *COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles the first stays."""
    return simhash.keep_one(only(docs, *COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that an earlier document has go."""
    return substring_index.cut_documents(only(docs, *COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of cost-balanced sequences of 1024 tokens."""
    return packing.pack_documents(documents(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_runs),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", passages),
    ("packing", sequences),
]

#: SQL has no tokenizer, and no SimHash: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return docs
