"""Nested cross-validation by works: inner folds, scorers of all folds in one pass, inner choice, outer evaluation.

The works of a corpus are few and named on the driver, as the models are; examples and scores stay on the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gradients as G
from ..functions import vectors as V
from .dealing import ROWS_A_TASK
from .selection import best, budget_of, by_scores
from .training import summed

#: Selections from scores: all splits from a threshold on, or a share of the possible splits.
MODES = ("threshold", "budget")


def inner_folds(works: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(outer_work, work, fold): for each work, the others in the order of a hash, cut into n folds of nearly equal size.

    With fewer others than folds each is a fold of its own; the larger folds come first.
    """
    one = works.select("work").distinct()
    pairs = one.select(F.col("work").alias("outer_work")).join(one, F.col("outer_work") != F.col("work"))
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), "outer_work", "work"), 256)
    return pairs.select("outer_work", "work", (F.ntile(n).over(Window.partitionBy("outer_work").orderBy(key, "work")) - 1).alias("fold"))


def assignments(folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (model, work) that models are fitted on, and trials (model, outer_work, work, stage) that they are tried on.

    Each inner fold has a model of the other folds and is tried on itself; the refit of a work has all other works and is
    tried on the work.
    """
    name = lambda fold: F.concat_ws("|", "outer_work", fold)
    own = folds.select("outer_work", F.col("fold").alias("left_out")).distinct()
    inner = folds.join(own, "outer_work").where("fold <> left_out").select(name(F.col("left_out").cast("string")).alias("model"), "work")
    refit = folds.select(name(F.lit("refit")).alias("model"), "work")
    tried = folds.select(name(F.col("fold").cast("string")).alias("model"), "outer_work", "work", F.lit("inner").alias("stage"))
    tested = folds.select("outer_work").distinct().select(name(F.lit("refit")).alias("model"), "outer_work", F.col("outer_work").alias("work"), F.lit("outer").alias("stage"))
    return inner.unionByName(refit), tried.unionByName(tested)


def scorer_gradient(x: np.ndarray, y: np.ndarray, c: np.ndarray, w: dict) -> tuple[float, dict]:
    """(loss, gradient) of weighted cross entropy summed over examples x and models; c: weight of each example in each model."""
    e = np.exp(w["logits"] - w["logits"].max(axis=1, keepdims=True))
    share = e / e.sum(axis=1, keepdims=True)
    mix = x @ share.T - 0.5
    gain = np.logaddexp(0, w["raw_gain"])
    z = w["intercept"] + gain * mix
    error = c * (1 / (1 + np.exp(-z)) - y[:, None])
    d_share = (error * gain).T @ x
    g = {
        "intercept": error.sum(axis=0), "raw_gain": (error * mix).sum(axis=0) / (1 + np.exp(-w["raw_gain"])),
        "logits": share * (d_share - (d_share * share).sum(axis=1, keepdims=True)),
    }
    return float((c * (np.logaddexp(0, z) - y[:, None] * z)).sum()), g


def fit_scorers(examples: DataFrame, features: list[str], label: str, members: DataFrame, epochs: int = 40, rate: float = 0.2) -> DataFrame:
    """(model, weights, gain, intercept): a logistic scorer with class-balanced weights for each model of members (model, work).

    examples: rows (work, label, features). All models step together: a task reads an example once an epoch and adds it
    to the gradients of the models that hold its work, so examples aren't copied for each fold. A task takes ROWS_A_TASK
    of them if there are so many, since each sends its sums once an epoch. A class that a model lacks has no weight.
    """
    spark = examples.sparkSession
    known = members.distinct().toArrow().to_pandas()
    models, works = sorted(known["model"].unique()), sorted(known["work"].unique())
    held = np.zeros((len(works), len(models)))
    held[np.searchsorted(works, known["work"]), np.searchsorted(models, known["model"])] = 1
    sizes = examples.groupBy("work").agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")).toArrow().to_pandas().set_index("work").reindex(works).fillna(0)
    pos, neg = sizes["pos"].to_numpy() @ held, (sizes["n"] - sizes["pos"]).to_numpy() @ held
    # weight[class] of each model, and its row of weights for each work
    each = [np.divide(0.5, n, out=np.zeros(len(models)), where=n > 0) for n in (neg, pos)]
    table = np.stack([held * w for w in each])
    w = {"logits": np.zeros((len(models), len(features))), "raw_gain": np.full(len(models), 1.0), "intercept": np.zeros(len(models))}
    adam = G.Adam(rate)
    rows = examples.where(F.col("work").isin(works)).select("work", F.col(label).cast("int").alias("_y"), *features)
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-int(sizes["n"].sum()) // ROWS_A_TASK)))
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast((w, table, works))

        def work(batches, shared=shared):
            now, weights, names = shared.value
            n, loss, g = 0.0, 0.0, np.zeros(sum(np.size(x) for x in now.values()))
            for f in batches:
                if len(f):
                    y = f["_y"].to_numpy()
                    c = weights[y, np.searchsorted(names, f["work"].to_numpy(str))]
                    one, d = scorer_gradient(f[features].to_numpy(float), y.astype(float), c, now)
                    n, loss, g = n + len(f), loss + one, g + G.flat(d)
            return n, loss, g

        _, _, g = summed(rows, work)
        if len(g):
            w = adam.step(w, G.shaped(g, w))
    e = np.exp(w["logits"] - w["logits"].max(axis=1, keepdims=True))
    share, gain = e / e.sum(axis=1, keepdims=True), np.logaddexp(0, w["raw_gain"])
    out = [(m, [float(v) for v in share[k]], float(gain[k]), float(w["intercept"][k])) for k, m in enumerate(models)]
    return spark.createDataFrame(out, "model string, weights array<double>, gain double, intercept double")


def scored_by(rows: DataFrame, features: list[str], trials: DataFrame, models: DataFrame) -> DataFrame:
    """rows of each trial (model, work, ...) with the `score` of its model.

    Trials and models, which works alone bring about, are broadcast; rows, which grow with the corpus, stay where they are.
    """
    mix = sum((F.col(c) * F.get("weights", F.lit(k)) for k, c in enumerate(features)), F.lit(0.0))
    both = rows.join(F.broadcast(trials.join(F.broadcast(models), "model")), "work")
    return both.withColumn("score", V.sigmoid(F.col("intercept") + F.col("gain") * (mix - 0.5))).drop("weights", "gain", "intercept", "model")


def candidate_counts(scored: DataFrame, thresholds: list[float], ratios: list[float]) -> DataFrame:
    """(stage, outer_work, work, piece, mode, value, tp, fp, fn) of scored splits (..., split, positive, score) for each candidate.

    A threshold takes the splits from its score on, a ratio the best splits within its budget, the earlier on ties.
    """
    piece = Window.partitionBy("stage", "outer_work", "work", "piece")
    ranked = scored.withColumn("_r", F.row_number().over(piece.orderBy(F.desc("score"), "split"))).withColumn("_n", F.count("*").over(piece) + 1)
    grid = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(float(v)).alias("value")) for m, values in zip(MODES, (thresholds, ratios), strict=True) for v in values))
    each = ranked.withColumn("_c", F.explode(grid)).select("*", "_c.mode", "_c.value")
    taken = F.when(F.col("mode") == MODES[0], F.col("score") >= F.col("value")).otherwise(F.col("_r") <= budget_of(F.col("value"), F.col("_n")))
    count = lambda c: F.sum(c.cast("long"))
    hit = F.col("positive")
    return each.groupBy("stage", "outer_work", "work", "piece", "mode", "value").agg(count(taken & hit).alias("tp"), count(taken & ~hit).alias("fp"), count(~taken & hit).alias("fn"))


def nested_select(rated: DataFrame) -> DataFrame:
    """(outer_work, mode, value, inner_f1, f1, recall, precision): each work under the candidate its inner folds chose.

    rated: rows (stage, outer_work, work, piece, mode, value, f1, recall, precision). A candidate's inner score is its
    mean over works of means over pieces. On ties of all three the smaller budget or the higher threshold is taken.
    """
    names = ("f1", "recall", "precision")
    by_work = rated.groupBy("stage", "outer_work", "mode", "value", "work").agg(*(F.avg(c).alias(c) for c in names))
    means = by_work.groupBy("stage", "outer_work", "mode", "value").agg(*(F.round(F.avg(c), 9).alias(c) for c in names))
    cautious = F.when(F.col("mode") == MODES[0], -F.col("value")).otherwise(F.col("value"))
    chosen = best(means.where("stage = 'inner'"), ["outer_work", "mode"], *by_scores(cautious))
    outer = means.where("stage = 'outer'").drop("stage")
    return chosen.select("outer_work", "mode", "value", F.col("f1").alias("inner_f1")).join(outer, ["outer_work", "mode", "value"])


def misused(audit: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, tests, violations): test accesses of each run in audit (keys, order, event), and those before its first freeze.

    Events are `freeze`, `test` and others; a run that never froze has all its tests as violations.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frozen = F.coalesce(F.max((F.col("event") == "freeze").cast("int")).over(before), F.lit(0))
    rows = audit.withColumn("_bad", (F.col("event") == "test") & (frozen == 0))
    return rows.groupBy(*keys).agg(F.sum((F.col("event") == "test").cast("long")).alias("tests"), F.sum(F.col("_bad").cast("long")).alias("violations"))
