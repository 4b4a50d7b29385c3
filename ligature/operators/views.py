"""Views of the given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dealing import spread

#: 2024-01-01 in microseconds; onsets are hours since then.
EPOCH = 1_704_067_200_000_000


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece, work, onset, dur, midi, event_id, event_type, value) from events, a piece in one partition."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = (F.unix_micros(F.col("ts").cast("timestamp_ltz")) - EPOCH) / F.lit(3.6e9)
    rows = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("piece"), F.concat(F.lit("w"), (F.col("user_id") % 16).cast("string")).alias("work"), hours.alias("onset"),
        (F.col("value") / 60.0).alias("dur"), (36 + F.col("event_id") % 61).cast("int").alias("midi"), "event_id", "event_type", "value",
    )
    return spread(rows, e, "piece")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of at least 120 s with their type as local key."""
    return notes(spark, sf_dir).where("value >= 120").withColumnRenamed("event_type", "localkey")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece, work, cfg, seed, tp, fp, fn): counts of event types by piece and a configuration dealt by event."""
    n = notes(spark, sf_dir).withColumn("cfg", (F.col("event_id") % 3).cast("int")).withColumn("seed", (F.floor(F.col("event_id") / 3) % 2).cast("int"))
    count = lambda low, high: F.sum(((F.col("value") >= low) & (F.col("value") < high)).cast("long"))
    return n.groupBy("piece", "work", "cfg", "seed").agg(count(40, 1e9).alias("tp"), count(20, 40).alias("fp"), count(0, 20).alias("fn"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece, leaf, start, end, vec, label): embeddings in runs of 25."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    leaf = (F.col("vec_id") % 25).cast("int")
    return e.select(F.concat(F.lit("s"), F.floor(F.col("vec_id") / 25).cast("string")).alias("piece"), leaf.alias("leaf"), leaf.cast("double").alias("start"), (leaf + 1).cast("double").alias("end"), F.col("embedding").cast("array<double>").alias("vec"), "label")
