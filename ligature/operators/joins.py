"""Joins with the checks that data manifests need, and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either side with status and reason: included if both have it."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    both = a.join(b, key, "full")
    reason = F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").otherwise("")
    return both.select(key, F.when(reason == "", "included").otherwise("excluded").alias("status"), reason.alias("reason"))


def checked_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with matches, status, reason: a null key is unrecognised, no match missing, several ambiguous."""
    counts = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("matches"))
    out = left.join(counts, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    reason = F.when(F.col(key).isNull(), "unrecognised").when(F.col("matches") == 0, "missing").when(F.col("matches") > 1, "ambiguous").otherwise("")
    return out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "included").otherwise("excluded"))


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Pairs where inner (s, e) lies within outer (start, end) of the same key; those that cross an end drop out."""
    return inner.join(outer, key).where((F.col("s") >= F.col("start")) & (F.col("e") <= F.col("end")))


def first_section(points: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Points (key, t) with the first section (start, end) such that start <= t < end; others drop out."""
    hit = points.join(sections, key).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    return hit.withColumn("_r", F.row_number().over(Window.partitionBy(key, "t").orderBy("start", "end"))).where("_r = 1").drop("_r")


def safe_pairs(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (piece, first, last) with no mark (piece, split) strictly inside: first < split <= last."""
    m = marks.select(F.col("piece").alias("mp"), F.col("split").alias("ms"))
    return pairs.join(m, (F.col("piece") == F.col("mp")) & (F.col("ms") > F.col("first")) & (F.col("ms") <= F.col("last")), "left_anti")


def quarter_beats(rows: DataFrame, measures: DataFrame, beat: float = 1.0) -> DataFrame:
    """rows (measure, beat text) with `t`: the measure's offset plus beats; a blank beat is 1; never negative.

    The first offset of a measure counts; a measure without an offset has a null time.
    """
    first = measures.groupBy("measure").agg(F.min("offset").alias("offset"))
    b = F.coalesce(F.when(F.trim("beat") == "", F.lit(1.0)).otherwise(F.col("beat").try_cast("double")), F.lit(1.0))
    shift = F.when(b > 0, (b - 1) * beat).otherwise(b * beat)
    return rows.join(first, "measure", "left").withColumn("t", F.when(F.col("offset").isNotNull(), F.greatest(F.lit(0.0), F.col("offset") + shift)))
