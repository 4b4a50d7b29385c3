"""Readers of annotated pieces: tab-separated notes and harmonies, JSON labels, and file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fraction

NOTES = "quarterbeats string, duration_qb string, midi int"
HARMONIES = "quarterbeats string, duration_qb string, globalkey string, localkey string, mc int, mc_onset string, pedal string"
LABELS = "struct<labels:array<struct<type:string,start:double,duration:double,`actual-duration`:double,tag:string,staff:string>>>"


def stem(suffix: str):
    """The name of the file that a row came from, without its suffix."""
    return F.regexp_extract(F.input_file_name(), rf"([^/]+?){suffix}$", 1)


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(piece, onset, dur, midi) of *.notes.tsv files; rows without a time are dropped. Columns go by the header."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return raw.select(stem(r"\.notes\.tsv").alias("piece"), fraction(F.col("quarterbeats")).alias("onset"), fraction(F.col("duration_qb")).alias("dur"), F.col("midi").try_cast("int").alias("midi")).where("onset is not null")


def harmonies(spark: SparkSession, path: str) -> DataFrame:
    """(piece, row, onset, dur, localkey) of *.harmonies.tsv files; rows without time or key are dropped."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    out = raw.select(stem(r"\.harmonies\.tsv").alias("piece"), F.monotonically_increasing_id().alias("row"), fraction(F.col("quarterbeats")).alias("onset"), fraction(F.col("duration_qb")).alias("dur"), "localkey")
    return out.where("onset is not null and localkey is not null")


def parsed_labels(texts: DataFrame, text: str = "value") -> DataFrame:
    """texts with one row for each JSON label: kind (cadence, pedal, motive, other), start, duration, tag, staff."""
    item = F.explode(F.from_json(text, LABELS)["labels"]).alias("l")
    rows = texts.select(*(c for c in texts.columns if c != text), item)
    kind = F.when(F.col("l.type") == "Cadence", "cadence").when(F.col("l.type") == "Pedal", "pedal").when(F.col("l.type").rlike("^(CS|S)"), "motive").otherwise("other")
    length = F.coalesce(F.nullif("l.duration", F.lit(0.0)), F.col("l.actual-duration"), F.lit(0.0))
    return rows.select(*(c for c in texts.columns if c != text), kind.alias("kind"), F.coalesce("l.start", F.lit(0.0)).alias("start"), length.alias("duration"), F.col("l.tag").alias("tag"), F.col("l.staff").alias("staff"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(piece, kind, start, duration, tag, staff) of label files, each one JSON object."""
    whole = spark.read.option("wholetext", True).text(path).select(stem(r"\.[a-z]+").alias("piece"), "value")
    return parsed_labels(whole)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files of a folder; the contents stay in the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of strings, blanks as ''."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).na.fill("")
