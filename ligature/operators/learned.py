"""Learned distances, merge policies and boundary scorers applied to pieces."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..functions import vectors as V
from .dealing import dealt
from .packs import CELLS, arrow_schema, by_length
from .trees import NODES, node_rows

ENCODERS = {"harmonic": E.harmonic, "plain": E.plain}
#: A scorer is fitted on at most this many examples, chosen by a hash of their identity.
MOST_EXAMPLES = 200_000


def embedded(leaves: DataFrame, name: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """leaves with `vec` replaced by the 16 numbers of an encoder."""
    shared = leaves.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(ENCODERS[name](np.array(v.tolist(), float), shared.value)))

    return leaves.withColumn("vec", run(F.col("vec")))


def boundary_logit(distance, raw_scale: float, bias: float):
    """The head of a pair model: a positive scale of the distance, and a bias."""
    return V.softplus(F.lit(raw_scale)) * distance + F.lit(bias)


def policy_trees(leaves: DataFrame, encoder: dict[str, np.ndarray], merge: dict[str, np.ndarray]) -> DataFrame:
    """Node tables of the likeliest merges of a policy."""
    shared = leaves.sparkSession.sparkContext.broadcast((encoder, merge))
    packed = dealt(leaves, "piece").groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("leaf", "start", "end", F.col("vec").cast("array<double>").alias("vec")))).alias("leaves"))

    def run(batches):
        for batch in batches:
            pieces, schema = batch["piece"].to_pylist(), arrow_schema(NODES)
            for at, vectors, edges in by_length(batch["leaves"], CELLS // 16):
                merges, logp = E.rollouts(vectors, *shared.value)
                rows = [row for p, nodes, ends, one in zip(at.tolist(), merges.tolist(), edges, logp.tolist(), strict=True) for row in node_rows(pieces[p], nodes, ends, None, one)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return packed.mapInArrow(run, NODES)


def fit_scorer(examples: DataFrame, features: list[str], label: str, identity: list[str], most: int = MOST_EXAMPLES) -> dict:
    """A logistic scorer of labelled examples with class-balanced weights, from a bounded sample."""
    some = examples.select(*features, F.col(label).cast("double").alias("_y"), F.xxhash64(*identity).alias("_h")).orderBy("_h").limit(most).toArrow().to_pandas()
    y = some["_y"].to_numpy()
    weights = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    return E.fit_logistic(some[features].to_numpy(float), y, weights)


def scored(rows: DataFrame, features: list[str], model: dict | None = None) -> DataFrame:
    """rows with `score`: the mean of the features, or the fitted scorer's probability."""
    if model is None:
        return rows.withColumn("score", sum((F.col(c) for c in features[1:]), F.col(features[0])) / len(features))
    mix = sum((F.col(c) * float(w) for c, w in zip(features, model["weights"], strict=True)), F.lit(0.0))
    return rows.withColumn("score", V.sigmoid(F.lit(model["intercept"]) + F.lit(model["gain"]) * (mix - 0.5)))
