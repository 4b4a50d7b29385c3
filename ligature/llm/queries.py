"""The queries of this subpackage, one for each operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lang_id, lm_score, media, near_dup, oracles, packing, periodic, quality, secret_scan, sp_codec, substrings, suffix_dedup, token_counts, whiten
from ..shipping import ship
from .common import documents


def op1_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(documents(spark, sf_dir))


def op2_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(documents(spark, sf_dir))


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(documents(spark, sf_dir), good)


def op4_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(documents(spark, sf_dir))


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.digests(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op8_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(documents(spark, sf_dir))


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return whiten.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_recompressed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.first_kept(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_marginal_unigrams": op1_marginal_unigrams, "op2_adaptive_quality": op2_adaptive_quality, "op3_cross_entropy_difference": op3_cross_entropy_difference, "op4_section_tokens": op4_section_tokens, "op5_sentencepiece_codec": op5_sentencepiece_codec, "op6_best_fit_packing": op6_best_fit_packing, "op7_prefix_doubling_dedup": op7_prefix_doubling_dedup, "op8_bottom_k_near_duplicates": op8_bottom_k_near_duplicates, "op9_markov_secrets": op9_markov_secrets, "op10_media_columns": op10_media_columns, "op11_periodic_runs": op11_periodic_runs, "op12_whitened_embeddings": op12_whitened_embeddings, "op13_recompressed_passages": op13_recompressed_passages}


def oracle_sql() -> dict[str, str]:
    return {"op2_adaptive_quality": oracles.QUALITY, "op7_prefix_doubling_dedup": oracles.REPEATED_STRINGS, "op8_bottom_k_near_duplicates": oracles.NEAR_DUPLICATES, "op10_media_columns": oracles.MEDIA_COLUMNS, "op11_periodic_runs": oracles.PERIODIC_RUNS, "op13_recompressed_passages": oracles.EARLIER_PASSAGES}
