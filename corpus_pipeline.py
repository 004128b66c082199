"""A training corpus from raw documents: classify, deduplicate, decontaminate, redact, pack.

Each stage takes what its predecessor kept. All but the last return the columns of documents, extra ones included.
In every stage a null text counts as an empty one and stays null, rows with null doc_ids are kept (packing packs them like others), equal rows share their fate,
very long texts are read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lintel.llm import decontamination, packing, quality_classifier, secret_scan, simhash
from lintel.llm.common import saved, table

#: Quality scores from here on stay.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents of the table. Without labels all stay."""
    return quality_classifier.keep(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")), QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the one with the least doc_id; texts of one doc_id are judged each on its own."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Without a benchmark all stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars counts the new text."""
    return secret_scan.mask(docs, secret_scan.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, packing.word_bpe(public_tokenizers.path("word_bpe_49k.json")), size=2048, end_id=1)


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("secret scans", secrets), ("packing", pack)]
#: Models and fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
