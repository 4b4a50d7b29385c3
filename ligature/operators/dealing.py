"""How pieces are dealt to tasks."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame


#: Rows of a table that one task takes at most, on average.
ROWS_A_TASK = 25_000


def spread(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """rows, derived from table, with equal keys in one of as many partitions as the table's size asks for.

    Adaptive execution merges shuffled partitions by their compressed bytes, which leaves millions of rows in one task. A
    number that grows with the table keeps a task's sorts, hash maps and pairs of leaves the same at any size, and joins,
    windows and groupings by the keys, or by more than these, need no further shuffle. The count of a Parquet table comes from its footers.
    """
    return rows.repartition(max(1, -(-table.count() // ROWS_A_TASK)), *keys)


def rows_read(rows: DataFrame) -> int:
    """How many rows the Parquet files have that rows derive from, by their footers; 0 if there are none."""
    files = [unquote(f) for f in rows.inputFiles() if f.endswith(".parquet")]
    return rows.sparkSession.read.parquet(*files).count() if files else 0


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with equal keys in one of as many partitions as there are cores, or shuffle partitions if these are more.

    Packed pieces are small but cost much time each. Adaptive execution would merge partitions by their bytes into one
    or two tasks; a stated number of partitions stays, and a grouping by the keys needs no further shuffle. Large tables
    are dealt to more tasks, one for each ROWS_A_TASK rows, so the longest task doesn't grow with them.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_read(rows) // ROWS_A_TASK)), *keys)
