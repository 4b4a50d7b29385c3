"""Labelled pairs of intervals on both sides of a split, for training distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .affinity import nearest_edges
from .matching import projected
from .selection import sample_per_group

#: How many leaves an interval holds.
CONTEXTS = (1, 2, 4, 8)


def positive_splits(leaves: DataFrame, marks: DataFrame, labels: str = "nearest") -> DataFrame:
    """(piece, split): splits at the edges nearest to marks, or at the distinct edges that marks are projected to in order."""
    edges = leaves.where("leaf > 0").select("piece", F.col("start").alias("t"), F.col("leaf").alias("split"))
    if labels == "nearest":
        found = nearest_edges(marks, edges.select("piece", "t"))
    elif labels == "projected":
        found = projected(marks, edges.select("piece", "t")).select("piece", "edge").distinct()
    else:
        raise ValueError(f"no such labels: {labels}")
    return found.join(edges.withColumnRenamed("t", "edge"), ["piece", "edge"]).select("piece", "split")


def interval_pairs(leaves: DataFrame, marks: DataFrame, contexts: tuple[int, ...] = CONTEXTS, labels: str = "nearest") -> DataFrame:
    """(piece, split, context, left, right, label): the summed vectors of so many leaves before and from each split.

    Splits with fewer leaves on a side than a context have no pair of it; label is 1 at positive splits. The sums are
    windows over one piece, so leaves are shuffled once, whatever the number of contexts.
    """
    order = Window.partitionBy("piece").orderBy("leaf")
    zero = F.array(*(F.lit(0.0) for _ in range(12)))
    vec = F.col("vec").cast("array<double>")
    added = lambda lists: F.aggregate(lists, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    each = [F.struct(F.lit(c).alias("context"), F.collect_list(vec).over(order.rowsBetween(-c, -1)).alias("l"), F.collect_list(vec).over(order.rowsBetween(0, c - 1)).alias("r")) for c in contexts]
    rows = leaves.select("piece", F.col("leaf").cast("int").alias("split"), F.array(*each).alias("e")).select("piece", "split", F.explode("e").alias("e"))
    full = rows.where((F.size("e.l") == F.col("e.context")) & (F.size("e.r") == F.col("e.context")))
    pairs = full.select("piece", "split", "e.context", added(F.col("e.l")).alias("left"), added(F.col("e.r")).alias("right"))
    positive = positive_splits(leaves, marks, labels).select("piece", F.col("split").cast("int").alias("split"), F.lit(1).alias("label"))
    return pairs.join(positive, ["piece", "split"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def training_pairs(leaves: DataFrame, marks: DataFrame, works: DataFrame, contexts: tuple[int, ...] = CONTEXTS, labels: str = "nearest", seed: int = 0) -> DataFrame:
    """interval_pairs with `work` and `id`, as many of either label in each work as the rarer one has, by a hash."""
    rows = interval_pairs(leaves, marks, contexts, labels).join(works.select("piece", "work").distinct(), "piece")
    rows = rows.withColumns({"id": F.concat_ws("|", "piece", "split", "context"), "_positive": F.col("label") == 1})
    return sample_per_group(rows, "work", "_positive", ["id"], seed).drop("_positive")
