"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where it is unset, and only in local mode, a temporary folder takes its place.
    """
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir")
    if place:
        if not context.getCheckpointDir():
            context.setCheckpointDir(place)
        return place
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and cut its lineage; Spark removes the files with the last reference, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
