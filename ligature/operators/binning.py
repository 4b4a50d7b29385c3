"""Time bins of timed events, and what is derived from them.

Notes are rows (piece, onset, dur, midi). A note is dealt to the bins that it overlaps by exploding their numbers, so
there is no range join; sums are partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(notes: DataFrame) -> DataFrame:
    """(piece, total): the end of the last note."""
    return notes.where(F.col("onset").isNotNull()).groupBy("piece").agg(F.max(F.col("onset") + F.col("dur")).alias("total"))


def histogram(notes: DataFrame, size: float | str) -> DataFrame:
    """(piece, bin, pc, weight): how long each pitch class sounds in each bin; cells without a note are absent.

    size may name a column of notes, which then is a key of the result too: several sizes take one shuffle.
    """
    if not isinstance(size, str) and size <= 0:
        raise ValueError("bin size must be positive")
    step, keys = step_of(size)
    n = F.ceil(F.col("total") / step).cast("int")
    end = F.col("onset") + F.col("dur")
    first = F.greatest(F.lit(0), F.floor(F.col("onset") / step).cast("int"))
    last = F.least(n - 1, F.floor(F.least(end, F.col("total") - 1e-9) / step).cast("int"))
    rows = notes.where(F.col("onset").isNotNull()).join(totals(notes), "piece").where(first <= last)
    rows = rows.select(*keys, F.pmod("midi", F.lit(12)).cast("int").alias("pc"), "onset", end.alias("end"), "total", F.explode(F.sequence(first, last)).alias("bin"))
    overlap = F.least(F.col("end"), F.least((F.col("bin") + 1) * step, F.col("total"))) - F.greatest(F.col("onset"), F.col("bin") * step)
    return rows.groupBy(*keys, "bin", "pc").agg(F.sum(F.greatest(F.lit(0.0), overlap)).alias("weight"))


def step_of(size: float | str) -> tuple[Column, list[str]]:
    """The bin size as a column, and the keys of bins."""
    return (F.col(size), ["piece", size]) if isinstance(size, str) else (F.lit(float(size)), ["piece"])


def of_sizes(notes: DataFrame, sizes: list[float]) -> DataFrame:
    """notes once for each bin size, in the column `size`."""
    return notes.withColumn("size", F.explode(F.array(*(F.lit(float(s)) for s in sizes))))


def bounds(notes: DataFrame, size: float) -> DataFrame:
    """(piece, bin, start, end) of every bin up to the end of the piece."""
    t = totals(notes)
    return t.select("piece", "total", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / size).cast("int") - 1)).alias("bin")).select(
        "piece", "bin", (F.col("bin") * F.lit(float(size))).alias("start"), F.least((F.col("bin") + 1) * F.lit(float(size)), F.col("total")).alias("end")
    )


def dense(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, vec): the 12 weights of each bin."""
    sums = [F.sum(F.when(F.col("pc") == k, F.col("weight")).otherwise(0.0)) for k in range(12)]
    return cells.groupBy(*keys).agg(F.array(*sums).alias("vec"))


def leaves(notes: DataFrame, size: float | str) -> DataFrame:
    """(piece, leaf, start, end, vec): sounding bins; silence goes to the nearer neighbour, cut between centres.

    size may name a column of notes, as in histogram.
    """
    step, keys = step_of(size)
    active = dense(histogram(notes, size).where("weight > 0"), *keys, "bin")
    rows = active.join(totals(notes), "piece")
    low, high = F.col("bin") * step, F.least((F.col("bin") + 1) * step, F.col("total"))
    rows = rows.withColumn("centre", (low + high) / 2)
    order = Window.partitionBy(*keys).orderBy("bin")
    left = (F.lag("centre").over(order) + F.col("centre")) / 2
    right = (F.lead("centre").over(order) + F.col("centre")) / 2
    return rows.select(*keys, (F.row_number().over(order) - 1).alias("leaf"), F.coalesce(left, F.lit(0.0)).alias("start"), F.coalesce(right, F.col("total")).alias("end"), "vec")


def sweep(notes: DataFrame) -> DataFrame:
    """(piece, start, end, pc, active): how many notes of each pitch class sound between neighbouring changes.

    Notes without duration don't count. Rows with nothing active are left out; the changes include 0 and the end.
    """
    some = notes.where("dur > 0").withColumn("pc", F.pmod("midi", F.lit(12)).cast("int"))
    end = F.col("onset") + F.col("dur")
    deltas = some.select("piece", "pc", F.col("onset").alias("t"), F.lit(1).alias("d")).unionAll(some.select("piece", "pc", end.alias("t"), F.lit(-1).alias("d")))
    times = deltas.select("piece", "t").unionAll(some.select("piece", F.lit(0.0).alias("t"))).distinct()
    steps = times.select("piece", "t", F.lead("t").over(Window.partitionBy("piece").orderBy("t")).alias("next"), F.row_number().over(Window.partitionBy("piece").orderBy("t")).alias("k"))
    begun = some.select("piece", "pc", F.col("onset").alias("t"), end.alias("e"))
    first = begun.join(steps.select("piece", "t", F.col("k").alias("k0")), ["piece", "t"])
    both = first.join(steps.select("piece", F.col("t").alias("e"), F.col("k").alias("k1")), ["piece", "e"])
    spread = both.select("piece", "pc", F.explode(F.sequence("k0", F.col("k1") - 1)).alias("k")).groupBy("piece", "pc", "k").agg(F.count("*").alias("active"))
    return spread.join(steps, ["piece", "k"]).select("piece", F.col("t").alias("start"), F.col("next").alias("end"), "pc", "active")


def prefix_sums(cells: DataFrame) -> DataFrame:
    """(piece, pc, bin, upto): weight of the pitch class up to and with the bin."""
    w = Window.partitionBy("piece", "pc").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("piece", "pc", "bin", F.sum("weight").over(w).alias("upto"))


def contexts(mass: DataFrame, width: int) -> DataFrame:
    """(piece, leaf, left, right): sums of the width values before and from each place that has as many on both sides."""
    order = Window.partitionBy("piece").orderBy("leaf")
    before, after = order.rowsBetween(-width, -1), order.rowsBetween(0, width - 1)
    out = mass.select("piece", "leaf", F.sum("value").over(before).alias("left"), F.sum("value").over(after).alias("right"), F.count("*").over(before).alias("a"), F.count("*").over(after).alias("b"))
    return out.where((F.col("a") == width) & (F.col("b") == width)).drop("a", "b")


def pick_resolution(notes: DataFrame, sizes: list[float], most: int, collapsed: bool = False) -> DataFrame:
    """(piece, size): the smallest size with at most so many bins (or sounding bins, if collapsed)."""
    parts = []
    for s in sizes:
        if collapsed:
            n = histogram(notes, s).where("weight > 0").groupBy("piece").agg(F.countDistinct("bin").alias("n"))
        else:
            n = totals(notes).select("piece", F.ceil(F.col("total") / s).alias("n"))
        parts.append(n.select("piece", "n", F.lit(float(s)).alias("size")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("n") <= most).groupBy("piece").agg(F.min("size").alias("size"), F.min_by("n", "size").cast("long").alias("n"))


def islands(rows: DataFrame, label: str, order: list[str], at: str, end: Column) -> DataFrame:
    """(piece, seg, start, end, label): runs of equal labels; a run ends where the next starts, the last at `end`."""
    w = Window.partitionBy("piece").orderBy(*order)
    changed = rows.withColumn("new", (~F.lag(label).over(w).eqNullSafe(F.col(label)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = changed.withColumn("seg", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("stop", end.over(Window.partitionBy("piece")))
    runs = numbered.where("new = 1").select("piece", "seg", F.col(at).alias("start"), F.col(label).alias("label"), "stop")
    return runs.select("piece", F.col("seg").cast("int").alias("seg"), "start", F.coalesce(F.lead("start").over(Window.partitionBy("piece").orderBy("seg")), F.col("stop")).alias("end"), "label")
