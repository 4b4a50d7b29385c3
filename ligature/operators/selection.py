"""Choice of configurations, folds and splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by a total order."""
    if not keys:
        return rows.orderBy(*order).limit(1)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def by_scores(*dims: Column) -> tuple[Column, ...]:
    """f1, recall and precision falling, then the dimensions."""
    return (F.desc("f1"), F.desc("recall"), F.desc("precision"), *dims)


def leave_one_work_out(scores: DataFrame, dims: list[str], values: tuple[str, ...] = ("f1", "recall", "precision")) -> DataFrame:
    """For each work the configuration that is best on the other works' mean of means, and the work's own scores there.

    Means without one work come from totals less the work's own row, so works aren't joined with each other.
    """
    own = scores.groupBy("work", *dims).agg(*(F.avg(v).alias(v) for v in values))
    all_ = own.groupBy(*dims).agg(*(F.sum(v).alias(f"s_{v}") for v in values), F.count("*").alias("n"))
    others = own.join(all_, dims).where("n > 1").select("work", *dims, *(((F.col(f"s_{v}") - F.col(v)) / (F.col("n") - 1)).alias(v) for v in values))
    rounded = others.select("work", *dims, *(F.round(v, 9).alias(v) for v in values))
    chosen = best(rounded, ["work"], *by_scores(*(F.asc(d) for d in dims))).select("work", *dims)
    return chosen.join(own, ["work", *dims])


def choose_ratio(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The ratio with the best f1 for each key, the smaller on ties."""
    return best(scores, keys, F.desc("f1"), F.asc("ratio"))


def budget_of(ratio: Column, n: Column) -> Column:
    """Boundaries for a share of the n - 1 possible ones: rounded half to even, at least 1, at most n - 1."""
    return F.least(n - 1, F.greatest(F.lit(1), F.bround(ratio * (n - 1)).cast("int")))


def simplex_grid(spark: SparkSession, dims: int, steps: int) -> DataFrame:
    """(w1, ..., wd): all points of the simplex in multiples of 1 / steps."""
    out = spark.range(1).select(F.lit(0).alias("used"))
    for d in range(1, dims):
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps) - F.col("used"))).alias(f"k{d}")).withColumn("used", F.col("used") + F.col(f"k{d}"))
    return out.select(*((F.col(f"k{d}") / steps).alias(f"w{d}") for d in range(1, dims)), ((steps - F.col("used")) / F.lit(steps)).alias(f"w{dims}"))


def blocked_split(works: list[str], parts: tuple[int, ...], seed: int) -> list[list[str]]:
    """Sorted works in a seeded order, cut into parts; works are names, of which there are few."""
    order = np.random.default_rng(seed).permutation(len(works))
    named = [sorted(works)[i] for i in order]
    cuts = np.cumsum((0, *parts))
    return [named[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def drawn(seed: int, *identity: str) -> Column:
    """The hash that orders rows by chance: of the seed and what identifies a row."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in identity)), 256)


def split_works(works: DataFrame, parts: dict[str, int], seed: int = 0) -> DataFrame:
    """(work, part): distinct works in the order of a hash, the first so many for each part; what is left over goes to the last.

    The order is one window over the works, which are names and few; rows aren't in it.
    """
    numbered = works.select("work").distinct().withColumn("_r", F.row_number().over(Window.orderBy(drawn(seed, "work"), "work")))
    names, upto = list(parts), np.cumsum(list(parts.values())).tolist()
    part = F.lit(names[-1])
    for name, most in reversed(list(zip(names[:-1], upto, strict=False))):
        part = F.when(F.col("_r") <= most, F.lit(name)).otherwise(part)
    return numbered.select("work", part.alias("part"))


def folds(rows: DataFrame, work: str, n: int, seed: int = 0) -> DataFrame:
    """rows with `fold`: works in the order of a hash are dealt to n folds, each work to one."""
    works = rows.select(work).distinct().withColumn("_h", drawn(seed, work))
    dealt = works.withColumn("fold", (F.row_number().over(Window.orderBy("_h", work)) - 1) % n).drop("_h")
    return rows.join(dealt, work)


def sample_per_group(rows: DataFrame, group: str, label: str, identity: list[str], seed: int = 0) -> DataFrame:
    """As many rows of either label in each group as the rarer one has, chosen by a hash of their identity."""
    w = Window.partitionBy(group, label).orderBy(drawn(seed, *identity), *identity)
    sizes = rows.groupBy(group).agg(F.least(F.sum(F.col(label).cast("int")), F.sum((~F.col(label)).cast("int"))).alias("k"))
    return rows.withColumn("_r", F.row_number().over(w)).join(sizes, group).where(F.col("_r") <= F.col("k")).drop("_r", "k")
