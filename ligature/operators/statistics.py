"""Corpus statistics: means in two levels, resampling and corrections. All are DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def work_means(scores: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means of pieces within each work and key."""
    return scores.groupBy("work", *keys).agg(*(F.avg(v).alias(v) for v in values))


def macro(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, works, mean, std) over works of the means of their pieces; the deviation of one work is null."""
    return work_means(scores, keys, [value]).groupBy(*keys).agg(F.countDistinct("work").alias("works"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def grouped_mean(scores: DataFrame, group: str, value: str) -> DataFrame:
    """One row (mean): the mean of group means, 0 without any."""
    return scores.groupBy(group).agg(F.avg(value).alias("m")).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("mean"))


def micro(scores: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and f1 of summed tp, fp, fn."""
    s = scores.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def seed_summary(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and deviation across seeds of each seed's macro mean."""
    one = macro(scores, [*keys, "seed"], value)
    return one.groupBy(*keys).agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"), F.count("*").alias("seeds"))


def gap(scores: DataFrame, keys: list[str], column: str, one: str, two: str, value: str) -> DataFrame:
    """Pivot a column to two of its values and compare: gap = one - two, relative to |two| (null if that is 0)."""
    wide = scores.groupBy(*keys).pivot(column, [one, two]).agg(F.avg(value))
    return wide.select(*keys, F.col(f"`{one}`").alias("a"), F.col(f"`{two}`").alias("b")).withColumn("gap", F.col("a") - F.col("b")).withColumn("relative", F.try_divide(F.col("gap"), F.abs(F.col("b"))))


def balanced_weights(rows: DataFrame, group: str, label: str | None = None) -> DataFrame:
    """rows with `weight`: inverse group size (with a label half for each class), with mean 1 over all rows."""
    raw = 1.0 / F.count("*").over(Window.partitionBy(group)) if label is None else 0.5 / F.count("*").over(Window.partitionBy(label))
    table = rows.withColumn("raw", raw)
    mean = table.agg(F.avg("raw").alias("mean")).withColumn("one", F.lit(1))
    return table.withColumn("one", F.lit(1)).join(F.broadcast(mean), "one").withColumn("weight", F.col("raw") / F.col("mean")).drop("raw", "mean", "one")


def holm(tests: DataFrame, *keys: str) -> DataFrame:
    """tests (keys, name, p) with `adjusted`: Holm's step-down, by p then name within keys."""
    w = Window.partitionBy(*keys).orderBy("p", "name")
    m = F.count("*").over(Window.partitionBy(*keys))
    step = tests.withColumn("raw", F.least(F.lit(1.0), F.col("p") * (m - F.row_number().over(w) + 1)))
    return step.withColumn("adjusted", F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("raw")


def quantile(sorted_values: Column, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return a + (b - a) * (at - low)


def bootstrap(values: DataFrame, key: str, value: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(key, n, mean, std, low, high): percentile interval of resampled means.

    Draws are hashes of (seed, key, resample, draw), so results don't depend on partitioning.
    """
    packed = values.where(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_x"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    n = F.size("_x")

    def one(r: Column) -> Column:
        draw = lambda i: F.get(F.col("_x"), F.pmod(F.xxhash64(F.lit(seed), F.col(key), r, i), n).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + draw(i)) / n

    means = packed.select(key, n.alias("n"), "mean", F.coalesce("std", F.lit(0.0)).alias("std"), F.sort_array(F.transform(F.sequence(F.lit(1), F.lit(resamples)), one)).alias("_means"))
    return means.select(key, "n", "mean", "std", quantile(F.col("_means"), 0.025).alias("low"), quantile(F.col("_means"), 0.975).alias("high"))


def sign_flips(scores: DataFrame, unit: str, method: str, value: str, draws: int = 10000, seed: int = 0) -> DataFrame:
    """(a, b, n, difference, p, adjusted) for each pair of methods: paired two-sided sign flips over units, then Holm.

    With at most 12 units every sign pattern is counted; else patterns are hashes.
    """
    one = scores.select(unit, F.col(method).alias("a"), F.col(value).alias("x"))
    two = scores.select(unit, F.col(method).alias("b"), F.col(value).alias("y"))
    pairs = one.join(two, unit).where("a < b").groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct(unit, (F.col("x") - F.col("y")).alias("d"))))["d"].alias("d"))
    n = F.size("d")
    observed = F.abs(F.aggregate("d", F.lit(0.0), lambda s, x: s + x))

    def flipped(sign) -> Column:
        return F.abs(F.aggregate(F.transform("d", lambda x, i: F.when(sign(i), x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x))

    exact = F.transform(F.sequence(F.lit(0), F.shiftleft(F.lit(1), 12) - 1), lambda k: flipped(lambda i: F.getbit(k, i) == 1))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda r: flipped(lambda i: F.pmod(F.xxhash64(F.lit(seed), "a", "b", r, i), F.lit(2)) == 1))
    hits = lambda xs: F.size(F.filter(xs, lambda x: x >= F.col("observed") - 1e-12))
    base = pairs.withColumn("observed", observed)
    p = F.when(n <= 12, hits(exact) / F.lit(4096)).otherwise((1 + hits(drawn)) / F.lit(draws + 1))
    out = base.select(F.concat_ws("|", "a", "b").alias("name"), "a", "b", n.alias("n"), (F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / n).alias("difference"), p.alias("p"))
    return holm(out.withColumn("all", F.lit(1)), "all").drop("all", "name")
