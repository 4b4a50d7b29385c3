"""Stages whose outputs are kept, so that a run that was stopped goes on where it ended.

A stage's folder is named by a hash of its name, its settings, and the keys of its inputs; changed settings or inputs so
get a new folder, and so do all later stages. Spark writes the mark of a folder (_SUCCESS) with its commit: a folder
without it, from a run that died, is written anew, and one with it is read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MARK = "_SUCCESS"


@dataclass(frozen=True)
class Stage:
    """work(spark, inputs, settings) gives the table of a stage from those of the named earlier ones."""

    name: str
    work: Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]
    inputs: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)


def hashed(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def source_key(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of the files of a source; contents aren't read."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    facts, queue = [], list(found or [])
    while queue:
        s = queue.pop()
        if s.isDirectory():
            queue += list(s.getPath().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(s.getPath()))
        else:
            facts.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashed(sorted(facts))


def written(spark: SparkSession, folder: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MARK}")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, folder: str, stages: list[Stage], sources: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str, str]]]:
    """(tables by stage, report): runs the stages in order; report rows are (stage, key, `kept` or `made`).

    sources are Parquet tables by name, which stages may take as inputs; their keys follow their files. Stages with the
    same inputs and settings give the same key, so a second run reads what the first has committed.
    """
    keys = {name: source_key(spark, path) for name, path in (sources or {}).items()}
    tables = {name: spark.read.parquet(path) for name, path in (sources or {}).items()}
    report = []
    for s in stages:
        if s.name in keys:
            raise ValueError(f"two stages or sources are called {s.name}")
        missing = [i for i in s.inputs if i not in keys]
        if missing:
            raise ValueError(f"{s.name} needs {', '.join(missing)}, which no earlier stage makes")
        keys[s.name] = hashed(s.name, s.settings, [keys[i] for i in s.inputs])
        place = f"{folder.rstrip('/')}/{s.name}-{keys[s.name]}"
        kept = written(spark, place)
        if not kept:
            s.work(spark, {i: tables[i] for i in s.inputs}, dict(s.settings)).write.mode("overwrite").parquet(place)
        tables[s.name] = spark.read.parquet(place)
        report.append((s.name, keys[s.name], "kept" if kept else "made"))
    return {s.name: tables[s.name] for s in stages}, report
