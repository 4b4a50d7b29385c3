"""Manifests of data sets: which annotation goes with which score, what is left out and why, and from which revision.

Contents and checksums stay in the executors; only one revision for each folder is found on the driver.
"""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("dataset", "work", "piece", "annotation_path", "score_path", "status", "reason", "annotation_sha256", "score_sha256")


def files(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """(path, name, content, sha256) of the files under path with one of the suffixes, or of all."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if suffixes:
        raw = raw.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes]))
    return raw.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content", F.sha2("content", 256).alias("sha256"))


def revision(path: str | Path) -> str:
    """The commit that the working copy at a local path is at; '' where it is none."""
    if not Path(path).is_dir():
        return ""
    try:
        found = subprocess.run(["git", "-C", str(path), "rev-parse", "HEAD"], capture_output=True, text=True, check=False, timeout=60)
    except FileNotFoundError:
        return ""
    return found.stdout.strip() if found.returncode == 0 else ""


def _row(dataset: str, work: Column, piece: str, score: str, reason: Column) -> list[Column]:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    status = F.when(reason == "", "included").otherwise("excluded")
    return [F.lit(dataset).alias("dataset"), work.alias("work"), F.col(piece).alias("piece"), text("path").alias("annotation_path"), text(f"{score}_path").alias("score_path"), status.alias("status"), reason.alias("reason"), text("sha256").alias("annotation_sha256"), text(f"{score}_sha256").alias("score_sha256")]


def looked_up(annotations: DataFrame, scores: DataFrame, dataset: str) -> DataFrame:
    """One row for each annotation (piece, work, key, path, sha256, issue) with its score of scores (key, path, sha256).

    An annotation is left out for the first of these reasons: it is invalid (issue isn't null), its key is null, no
    score has its key, or several have. Scores are counted before the join, so a key that many share stays one row.
    """
    found = scores.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("_n"), F.min(F.struct("path", "sha256")).alias("_s"))
    both = annotations.join(found, "key", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    only = lambda c: F.when(F.col("_n") == 1, F.col(f"_s.{c}"))
    both = both.withColumns({"_path": only("path"), "_sha256": only("sha256")})
    reason = F.when(F.col("issue").isNotNull(), F.concat(F.lit("annotation_invalid: "), "issue")).when(F.col("key").isNull(), "annotation_filename_unrecognised").when(F.col("_n") == 0, "paired_score_missing").when(F.col("_n") > 1, "paired_score_ambiguous").otherwise("")
    return both.select(*_row(dataset, F.col("work"), "piece", "", reason))


def matched(annotations: DataFrame, scores: DataFrame, dataset: str, work: Column) -> DataFrame:
    """One row for each piece of annotations or scores (piece, path, sha256); pieces that one side lacks are left out."""
    other = scores.select("piece", F.col("path").alias("_path"), F.col("sha256").alias("_sha256"))
    reason = F.when(F.col("path").isNull() | F.col("_path").isNull(), "notes_or_harmony_missing").otherwise("")
    return annotations.select("piece", "path", "sha256").join(other, "piece", "full").select(*_row(dataset, work, "piece", "", reason))


def with_revisions(manifest: DataFrame, revisions: dict[str, tuple[str, str]]) -> DataFrame:
    """manifest with annotation_revision and score_revision, given for each data set; '' for others."""
    pick = lambda k: F.coalesce(*(F.when(F.col("dataset") == d, F.lit(r[k])) for d, r in sorted(revisions.items())), F.lit(""))
    return manifest.withColumns({"annotation_revision": pick(0), "score_revision": pick(1)})
