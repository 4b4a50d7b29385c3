"""Joins that split keys which hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one part in so many of all rows is split, so there are at most so many of them to broadcast.
SHARE = 1000
#: No key of fewer rows is split.
LEAST_ROWS = 1000


def part_rows(sizes: DataFrame, n: str = "n") -> int:
    """The rows of a key from which on it is split."""
    return max(LEAST_ROWS, (sizes.agg(F.sum(n)).first()[0] or 0) // SHARE)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n", how: str = "inner", sizes: DataFrame | None = None, deal: Column | None = None, most: int | None = None) -> DataFrame:
    """rows joined with table, which has one row for each key; column n of sizes (or table) counts the rows of a key.

    Keys of over a thousandth of all rows are split into parts of at most that size. These keys, at most SHARE of them,
    are the only thing that goes to the driver; their rows of table are repeated once for each part. So no key fills a
    task, and without such keys this is a plain join. Parts are dealt by the hash `deal`, or else by row number; then
    rows must come from a scan or a checkpoint. most, the size of a part, spares summing n.
    """
    sizes = table if sizes is None else sizes
    most = most or part_rows(sizes, n)
    hot = sizes.where(F.col(n) > most).select(*keys, F.ceil(F.col(n) / most).cast("int").alias("_parts"))
    found = hot.collect()
    if not found:
        return rows.join(table, keys, how)
    known = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id() if deal is None else deal).join(known, keys, "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod("_row", "_parts"), F.lit(0)).cast("int")).drop("_row", "_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    repeated = table.join(known, keys, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    return dealt.join(repeated, [*keys, "_part"], how).drop("_part")


def counted(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One row for each key with its number of rows, n; counts are summed before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *more)
