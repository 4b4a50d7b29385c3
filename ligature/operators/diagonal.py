"""Contrastive training of a diagonal metric by data-parallel steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gradients as G
from ..functions import vectors as V
from .training import softmax, summed


def contrastive(left: np.ndarray, right: np.ndarray, label: np.ndarray, margin: float, logits: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss, gradient in the logits), summed: equal sides are drawn together, boundaries (label 1) pushed to the margin."""
    w = softmax(logits)
    squares = (left - right) ** 2
    d = np.sqrt(squares @ w + 1e-12)
    short = np.maximum(margin - d, 0)
    loss = float(((1 - label) * d**2 + label * short**2).sum())
    slope = 2 * (1 - label) * d - 2 * label * short
    d_w = (slope / (2 * d)) @ squares
    return loss, w * (d_w - d_w @ w)


def train_diagonal(examples: DataFrame, epochs: int = 100, rate: float = 0.05, every: int = 25, validate: Callable[[np.ndarray], float] | None = None) -> tuple[np.ndarray, float, list[tuple[int, float, float | None]]]:
    """(weights, margin, history): twelve weights with sum 1 of a distance between unit vectors.

    examples: rows (left, right, label) with label 1 at boundaries. The margin is the median plain distance of
    boundaries (of all examples without any). History rows are (epoch, mean loss, validation score); every so many
    epochs and at the end `validate` scores the weights, and the best scored ones are returned, the earlier on ties.
    Without it, or without examples, the last weights are.
    """
    side = lambda c: V.l1_or_zero(F.col(c)).alias(c)
    rows = examples.select(side("left"), side("right"), F.col("label").cast("double").alias("label"))
    plain = F.sqrt(F.aggregate(F.zip_with("left", "right", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("left"))
    medians = rows.agg(F.median(F.when(F.col("label") == 1, plain)).alias("near"), F.median(plain).alias("all")).first()
    margin = next((float(m) for m in medians if m is not None), 0.0)
    w, adam, history = {"logits": np.zeros(12)}, G.Adam(rate), []
    kept, kept_score = softmax(w["logits"]), -np.inf
    for epoch in range(1, epochs + 1):
        shared = rows.sparkSession.sparkContext.broadcast(w["logits"])

        def work(batches, shared=shared):
            n, loss, g = 0.0, 0.0, np.zeros(12)
            for f in batches:
                if len(f):
                    one, d = contrastive(np.array(f["left"].tolist()), np.array(f["right"].tolist()), f["label"].to_numpy(float), margin, shared.value)
                    n, loss, g = n + len(f), loss + one, g + d
            return n, loss, g

        n, loss, g = summed(rows, work)
        if not n:
            return kept, margin, history
        w, score = adam.step(w, {"logits": g / n}), None
        if validate is None:
            kept = softmax(w["logits"])
        elif epoch % every == 0 or epoch == epochs:
            score = validate(softmax(w["logits"]))
            if score > kept_score + 1e-12:
                kept, kept_score = softmax(w["logits"]), score
        history.append((epoch, loss / n, score))
    return kept, margin, history
