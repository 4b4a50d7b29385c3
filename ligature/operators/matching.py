"""Matching of predicted boundaries and spans against references, and ranking metrics.

The order-preserving matches are small dynamic programs, one for each piece, over the piece's packed times; all else is
relational.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .dealing import dealt


def ordered_match(predicted: list, reference: list, cost) -> list[tuple[int, int]]:
    """Order-preserving pairs: most pairs, then least total cost, then the first pairs; cost(p, r) is None if they don't fit."""
    n, m = len(predicted), len(reference)
    best = [[(0, 0.0, ())] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            options = [best[i][j + 1], best[i + 1][j]]
            if (c := cost(predicted[i], reference[j])) is not None:
                k, total, pairs = best[i][j]
                options.append((k - 1, total + c, (*pairs, (i, j))))
            best[i + 1][j + 1] = min(options)
    return list(best[n][m][2])


def assignment(short: list[float], long_: list[float]) -> list[int]:
    """For each of the shorter sorted list a place in the longer, in order, with the least total distance, leftmost."""
    n, m = len(short), len(long_)
    worst = float("inf")
    cost = [[0.0] * (m + 1)] + [[worst] * (m + 1) for _ in range(n)]
    took = [[False] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(i, m + 1):
            cost[i][j] = cost[i][j - 1]
            if (x := cost[i - 1][j - 1] + abs(short[i - 1] - long_[j - 1])) < cost[i][j]:
                cost[i][j], took[i][j] = x, True
    out, i, j = [], n, m
    while i:
        if took[i][j]:
            out.append(j - 1)
            i -= 1
        j -= 1
    return out[::-1]


def packed(predicted: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """(piece, p, r): sorted arrays; predictions without repeats, references with theirs."""
    p = dealt(predicted, "piece").groupBy("piece").agg(F.sort_array(F.collect_set(column)).alias("p"))
    r = dealt(reference, "piece").groupBy("piece").agg(F.sort_array(F.collect_list(column)).alias("r"))
    none = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c if isinstance(c, str) else "p"].dataType))
    return p.join(r, "piece", "full").select("piece", none("p", p), none("r", r)).toDF("piece", "p", "r")


def boundary_scores(predicted: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """(piece, tp, fp, fn, precision, recall, f1, error) from rows (piece, t)."""

    def run(batches):
        for f in batches:
            rows = []
            for piece, p, r in zip(f["piece"], f["p"], f["r"], strict=True):
                pairs = ordered_match(list(p), list(r), lambda a, b: abs(a - b) if abs(a - b) <= tolerance else None)
                gap = sum(abs(p[i] - r[j]) for i, j in pairs)
                rows.append((piece, len(pairs), len(p) - len(pairs), len(r) - len(pairs), gap / len(pairs) if pairs else None))
            yield pd.DataFrame(rows, columns=["piece", "tp", "fp", "fn", "error"])

    counted = packed(predicted, reference, "t").mapInPandas(run, "piece string, tp long, fp long, fn long, error double")
    return with_rates(counted).select("piece", "tp", "fp", "fn", "precision", "recall", "f1", "error")


def with_rates(counted: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn; 0 where nothing can be divided."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def span_scores(predicted: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """Like boundary_scores for rows (piece, start, end): both ends must fit."""

    def fit(a, b):
        gaps = abs(a[0] - b[0]), abs(a[1] - b[1])
        return sum(gaps) if max(gaps) <= tolerance else None

    def run(batches):
        for f in batches:
            rows = []
            for piece, p, r in zip(f["piece"], f["p"], f["r"], strict=True):
                a, b = ([tuple(x.values()) for x in s] for s in (p, r))
                k = len(ordered_match(a, b, fit))
                rows.append((piece, k, len(a) - k, len(b) - k))
            yield pd.DataFrame(rows, columns=["piece", "tp", "fp", "fn"])

    spans = lambda df: df.select("piece", F.struct("start", "end").alias("s"))
    return with_rates(packed(spans(predicted), spans(reference), "s").mapInPandas(run, "piece string, tp long, fp long, fn long"))


def projected(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """(piece, t, edge): references at distinct edges in order with the least total distance; extra references drop out."""

    def run(batches):
        for f in batches:
            rows = []
            for piece, e, r in zip(f["piece"], f["p"], f["r"], strict=True):
                e, r = list(e), list(r)
                if len(r) <= len(e):
                    rows += [(piece, t, e[k]) for t, k in zip(r, assignment(r, e), strict=True)]
                else:
                    rows += [(piece, r[k], t) for t, k in zip(e, assignment(e, r), strict=True)]
            yield pd.DataFrame(rows, columns=["piece", "t", "edge"])

    return packed(edges, marks, "t").mapInPandas(run, "piece string, t double, edge double")


def spans_of(boundaries: DataFrame) -> DataFrame:
    """(piece, start, end) between neighbouring boundaries (piece, t)."""
    return boundaries.distinct().select("piece", F.col("t").alias("start"), F.lead("t").over(Window.partitionBy("piece").orderBy("t")).alias("end")).where("end is not null")


def best_iou(spans: DataFrame, intervals: DataFrame) -> DataFrame:
    """(piece, start, end, iou): the best overlap over union of each interval with any span of its piece."""
    s = spans.select("piece", F.col("start").alias("a"), F.col("end").alias("b"))
    inter = F.greatest(F.lit(0.0), F.least("end", "b") - F.greatest("start", "a"))
    iou = ratio(inter, (F.col("end") - F.col("start")) + (F.col("b") - F.col("a")) - inter)
    return intervals.join(s, "piece").groupBy("piece", "start", "end").agg(F.max(iou).alias("iou"))


def union_iou(one: DataFrame, two: DataFrame) -> DataFrame:
    """(piece, iou) of the unions of two sets of intervals, weighted by time: 1 if both are empty, 0 if one is.

    A sweep: both sets' ends are events, running counts say what is covered between them.
    """
    ends = lambda df, x, y: df.where("end > start").select("piece", F.col("start").alias("t"), F.lit(x).alias("x"), F.lit(y).alias("y")).unionAll(df.where("end > start").select("piece", F.col("end"), F.lit(-x), F.lit(-y)))
    events = ends(one, 1, 0).unionAll(ends(two, 0, 1)).groupBy("piece", "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    w = Window.partitionBy("piece").orderBy("t")
    run = events.select("piece", F.sum("x").over(w).alias("x"), F.sum("y").over(w).alias("y"), (F.lead("t").over(w) - F.col("t")).alias("d"))
    both, any_ = F.sum(F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("d")).otherwise(0.0)), F.sum(F.when((F.col("x") > 0) | (F.col("y") > 0), F.col("d")).otherwise(0.0))
    pieces = one.select("piece").unionAll(two.select("piece")).distinct()
    return pieces.join(run.groupBy("piece").agg(ratio(both, any_).alias("iou")), "piece", "left").select("piece", F.coalesce("iou", F.lit(1.0)).alias("iou"))


def average_precision(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, ap) over rows (keys, score, positive, at): mean precision at the positives by falling score, then `at`."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "at")
    ranked = scored.select(*keys, "positive", F.row_number().over(w).alias("rank"), F.sum(F.col("positive").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    return ranked.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("positive"), F.col("hits") / F.col("rank"))), F.lit(0.0)).alias("ap"))


def greedy_matches(predicted: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """(piece, r, p): each reference in turn takes the nearest free prediction within the tolerance."""

    def run(batches):
        for f in batches:
            rows = []
            for piece, p, r in zip(f["piece"], f["p"], f["r"], strict=True):
                free = list(p)
                for t in r:
                    near = [x for x in free if abs(x - t) <= tolerance]
                    if near:
                        x = min(near, key=lambda v: (abs(v - t), v))
                        free.remove(x)
                        rows.append((piece, t, x))
            yield pd.DataFrame(rows, columns=["piece", "r", "p"])

    return packed(predicted, reference, "t").mapInPandas(run, "piece string, r double, p double")
