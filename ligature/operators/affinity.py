"""Pairwise distances and affinities of the leaves of a piece, and the contrast at its splits.

Leaves are rows (piece, leaf, vec). Pairs are self joins on the piece: their number is bounded by the leaves of one
piece, not by the corpus, and pieces spread over partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def represented(leaves: DataFrame, name: str) -> DataFrame:
    """(piece, leaf, rep): leaves after the transform of a named distance; `plain` takes vectors as they are."""
    rep = F.col("vec").cast("array<double>") if name == "plain" else V.TRANSFORMS[name](F.col("vec"))
    return leaves.select("piece", "leaf", rep.alias("rep"))


def distances(reps: DataFrame) -> DataFrame:
    """(piece, i, j, d) for i < j."""
    a = reps.select("piece", F.col("leaf").alias("i"), F.col("rep").alias("x"))
    b = reps.select("piece", F.col("leaf").alias("j"), F.col("rep").alias("y"))
    return a.join(b, "piece").where("i < j").select("piece", "i", "j", V.l2(F.col("x"), F.col("y")).alias("d"))


def adjacent(leaves: DataFrame, d) -> DataFrame:
    """(piece, split, dist): d(left, right) of neighbouring leaves; split is the right one's number."""
    order = Window.partitionBy("piece").orderBy("leaf")
    pairs = leaves.withColumn("prev", F.lag("vec").over(order)).where("prev is not null")
    return pairs.select("piece", F.col("leaf").alias("split"), d(F.col("prev"), F.col("vec")).alias("dist"))


def scales(pairs: DataFrame) -> DataFrame:
    """(piece, scale): exact median of positive distances, 1 if there are none."""
    return pairs.groupBy("piece").agg(F.coalesce(F.median(F.when(F.col("d") > 1e-12, F.col("d"))), F.lit(1.0)).alias("scale"))


def affinity(pairs: DataFrame) -> DataFrame:
    """(piece, i, j, aff) for i < j, with the piece's own scale."""
    return pairs.join(scales(pairs), "piece").select("piece", "i", "j", V.rbf(F.col("d"), F.col("scale")).alias("aff"))


def smoothed(aff: DataFrame, leaves: DataFrame, radius: int) -> DataFrame:
    """Affinities averaged along diagonals over the offsets within radius that stay inside the piece."""
    half = aff.select("piece", "i", "j", "aff")
    order = Window.partitionBy("piece", F.col("j") - F.col("i")).orderBy("i").rowsBetween(-radius, radius)
    return half.select("piece", "i", "j", F.avg("aff").over(order).alias("aff"))


def contrasts(pairs: DataFrame, leaves: DataFrame, context: int) -> DataFrame:
    """(piece, split, contrast): mean distance across a split less half the mean distances within its two contexts.

    Contexts hold up to `context` leaves on each side; within a context of one leaf the mean is 0.
    """
    splits = leaves.where("leaf > 0").select("piece", F.col("leaf").alias("split"))
    near = pairs.where(F.col("j") - F.col("i") < 2 * context).join(splits, "piece").where((F.col("i") >= F.col("split") - context) & (F.col("j") < F.col("split") + context))
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("d"))), F.lit(0.0))
    across = mean((F.col("i") < F.col("split")) & (F.col("j") >= F.col("split")))
    left, right = mean(F.col("j") < F.col("split")), mean(F.col("i") >= F.col("split"))
    return near.groupBy("piece", "split").agg((across - (left + right) / 2).alias("contrast"))


def local_contrasts(reps: DataFrame, context: int) -> DataFrame:
    """contrasts of the distances of reps (piece, leaf, rep), from windows over the leaves near each split.

    A split needs no other pairs, so nothing is joined and leaves are read once.
    """
    order = Window.partitionBy("piece").orderBy("leaf")
    sides = reps.select(
        "piece", F.col("leaf").alias("split"), F.collect_list("rep").over(order.rowsBetween(-context, -1)).alias("l"), F.collect_list("rep").over(order.rowsBetween(0, context - 1)).alias("r")
    ).where("split > 0")
    mean = lambda d: F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(d), F.lit(1))
    across = F.flatten(F.transform("l", lambda x: F.transform("r", lambda y: V.l2(x, y))))
    within = lambda c: F.flatten(F.transform(c, lambda x, k: F.transform(F.slice(c, F.lit(1), k), lambda y: V.l2(y, x))))
    told = sides.select("piece", "split", across.alias("a"), within("l").alias("l"), within("r").alias("r"))
    return told.select("piece", "split", (mean(F.col("a")) - (mean(F.col("l")) + mean(F.col("r"))) / 2).alias("contrast"))


def robust_scaler(values: DataFrame, column: str) -> DataFrame:
    """One row (med, mad, scale): scale = max(1.4826 mad, median of positive values, 1e-8)."""
    med = values.agg(F.median(column).alias("med"), F.median(F.when(F.col(column) > 0, F.col(column))).alias("pos"), F.lit(1).alias("one"))
    dev = values.withColumn("one", F.lit(1)).join(F.broadcast(med), "one")
    return dev.groupBy("med", "pos").agg(F.median(F.abs(F.col(column) - F.col("med"))).alias("mad")).select("med", "mad", F.greatest(1.4826 * F.col("mad"), F.coalesce("pos", F.lit(0.0)), F.lit(1e-8)).alias("scale"))


def calibrated(values: DataFrame, column: str) -> DataFrame:
    """values with `calibrated` in [0, 1]: a sigmoid of the robust score with 0 at value 0."""
    one = robust_scaler(values, column).withColumn("one", F.lit(1))
    base = V.sigmoid(-F.col("med") / F.col("scale"))
    score = (V.sigmoid((F.col(column) - F.col("med")) / F.col("scale")) - base) / F.greatest(1.0 - base, F.lit(1e-12))
    return values.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("one", "med", "mad", "scale")


def hard_negatives(scored: DataFrame) -> DataFrame:
    """All positives and, for each work, as many of its best-scored negatives; rows (work, piece, split, score, positive).

    Negatives rank by falling score, then piece and split; the count of positives is a window, not a driver loop.
    """
    order = Window.partitionBy("work", "positive").orderBy(F.desc("score"), "piece", "split")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("wanted", F.sum(F.col("positive").cast("int")).over(Window.partitionBy("work")))
    return ranked.where(F.col("positive") | (F.col("rank") <= F.col("wanted"))).drop("rank", "wanted")


def nearest_edges(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """(piece, edge): the internal edge nearest to each mark (piece, t), the earlier on ties, without repeats."""
    both = marks.join(edges.select("piece", F.col("t").alias("edge")), "piece")
    best = both.groupBy("piece", "t").agg(F.min(F.struct(F.abs(F.col("edge") - F.col("t")).alias("d"), "edge")).alias("m"))
    return best.select("piece", F.col("m.edge").alias("edge")).distinct()
