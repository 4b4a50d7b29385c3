"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .skew import part_rows, spread_join


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the ends of links (a, b); a component is named by its least id.

    Each round takes the least label among neighbours and then the label of the label, and is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path. Ends with very many links, and labels
    of very many ends, are split.
    """
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c"), F.count("*").alias("n")).withColumnRenamed("a", "id"))
    most = part_rows(labels)
    while True:
        near = spread_join(both, labels.withColumnRenamed("id", "b"), ["b"], deal=F.xxhash64("a"), most=most).groupBy("a").agg(F.min("c").alias("c2"))
        better = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("c", "c2").alias("c"), F.col("c").alias("old"), F.col("n").alias("links"))
        better = cut(better)
        named = better.groupBy("c").agg(F.count("*").alias("n"))
        jump = better.select(F.col("id").alias("c"), F.col("c").alias("c3"))
        new = spread_join(better, jump, ["c"], how="left", sizes=named, deal=F.xxhash64("id"), most=most)
        new = cut(new.select("id", F.least("c", "c3").alias("c"), "old", F.col("links").alias("n")))
        labels = new.select("id", "c", "n")
        if new.where("c <> old").isEmpty():
            return labels.select("id", F.col("c").alias("component"))
