"""Shared helpers: inputs, shared storage, and memoised work on words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut as cut
from ..lineage import shared_dir
from ..shipping import ship

#: ASCII white space, the separators of words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]"
#: Texts are handled so many at a time, so that a batch of Spark's, which can be of megabytes, stays small.
SLICE_TEXTS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Tables:
    """Parquet tables of one call in a shared folder of their own; the folder goes when the with block ends.

    For wide tables of numbers, which take less than half of a checkpoint's size. What the block returns must not read
    them any more: it ends with cut() or numbers.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, new_folder(spark, "tables")

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read again."""
        folder = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, whatever body does with it."""
    return F.transform(F.array(value), body)[0]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, at most SLICE_TEXTS together."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE_TEXTS):
            yield batch.slice(k, SLICE_TEXTS)
