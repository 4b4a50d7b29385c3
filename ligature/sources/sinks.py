"""Writers of result tables and of trained weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMS = ("parquet", "csv", "json")


def write_table(table: DataFrame, folder: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """table as a folder of files; CSV has a header. Arrays and structs need Parquet or JSON."""
    if form not in FORMS:
        raise ValueError(f"no such form: {form}")
    writer = table.write.mode(mode)
    (writer.option("header", True) if form == "csv" else writer).format(form).save(folder)


def write_weights(spark: SparkSession, weights: dict[str, np.ndarray], folder: str, **facts: str) -> None:
    """Weights as rows (name, shape, numbers), and facts about their training as rows with the fact as text."""
    rows = [(k, [int(n) for n in np.shape(x)], [float(v) for v in np.ravel(x)], None) for k, x in sorted(weights.items())]
    rows += [(k, None, None, str(v)) for k, v in sorted(facts.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>, fact string").coalesce(1).write.parquet(folder)


def read_weights(spark: SparkSession, folder: str) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    """(weights, facts) as write_weights left them."""
    rows = spark.read.parquet(folder).orderBy("name").collect()
    weights = {r["name"]: np.array(r["numbers"], float).reshape(r["shape"]) for r in rows if r["numbers"] is not None}
    return weights, {r["name"]: r["fact"] for r in rows if r["numbers"] is None}


def best_checkpoint(runs: DataFrame) -> DataFrame:
    """The one row (folder, seed, ap) to use of runs (folder, seed, ap, complete, quick): the best validation score, the lower seed on ties.

    Incomplete and quick runs don't count.
    """
    formal = runs.where(F.col("complete") & ~F.col("quick") & F.col("ap").isNotNull() & ~F.isnan("ap"))
    return formal.orderBy(F.desc("ap"), F.asc("seed"), "folder").limit(1).select("folder", "seed", "ap")
