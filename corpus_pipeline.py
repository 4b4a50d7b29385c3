"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
docs of the next. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ligature.llm import near_dup, packing, quality, secret_scan, suffix_dedup
from ligature.llm.common import documents, new_folder, remove
from ligature.shipping import ship


#: Documents are near duplicates from this share of common five-word shingles on.
SIMILAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    ship(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return near_dup.keep_one(docs, percent=SIMILAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of fifty words or more that start more than once."""
    ship(spark)
    return suffix_dedup.strip(docs, unit=suffix_dedup.WORDS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    ship(spark)
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("secret scans", secrets), ("best-fit packing", packed)]

#: Sketches, fingerprints and tokenizers aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir; each result goes through the shared folder while it is needed."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    # The last stage writes the pieces to the shared folder before it returns, so it doesn't read docs again.
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)
    return out
