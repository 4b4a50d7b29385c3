"""Annotated regions by measure or time: keys, pedals, sections and their trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import joins


def key_ranges(rows: DataFrame) -> DataFrame:
    """(piece, seg, start, end, label) of runs of `localkey` by `row`: a run ends a measure before the next starts.

    Rows without a key are skipped; the last run ends with the piece. A run may end before it starts, where two keys
    change in one measure.
    """
    w = Window.partitionBy("piece").orderBy("row")
    some = rows.withColumn("stop", F.max("mc").over(Window.partitionBy("piece"))).where("localkey is not null")
    new = some.withColumn("before", F.lag("localkey").over(w)).where("before is null or before <> localkey")
    order = Window.partitionBy("piece").orderBy("row")
    return new.select("piece", (F.row_number().over(order) - 1).alias("seg"), F.col("mc").alias("start"), F.coalesce(F.lead("mc").over(order) - 1, F.col("stop")).alias("end"), F.col("localkey").alias("label"))


def pedal_ranges(rows: DataFrame) -> DataFrame:
    """(piece, start, end, label) of runs of equal `pedal` by `row`; rows without one break a run."""
    w = Window.partitionBy("piece").orderBy("row")
    marked = rows.withColumn("new", (~F.lag("pedal").over(w).eqNullSafe(F.col("pedal"))).cast("int"))
    run = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("pedal is not null")
    return run.groupBy("piece", "run", F.col("pedal").alias("label")).agg(F.min_by("mc", "row").alias("start"), F.max_by("mc", "row").alias("end")).select("piece", "start", "end", "label")


def key_tree(rows: DataFrame) -> DataFrame:
    """(piece, level, start, end, label): root, key ranges, and the pedals that lie wholly inside a key range."""
    keys = key_ranges(rows)
    pedals = pedal_ranges(rows).select("piece", F.col("start").alias("s"), F.col("end").alias("e"), F.col("label").alias("pedal"))
    inside = joins.contained(pedals, keys, "piece").select("piece", F.lit(2).alias("level"), F.col("s").alias("start"), F.col("e").alias("end"), F.concat(F.lit("Ped["), "pedal", F.lit("]")).alias("label"))
    root = rows.groupBy("piece").agg(F.lit(0).alias("level"), F.min("mc").alias("start"), F.max("mc").alias("end"), F.lit("ROOT").alias("label"))
    return root.unionByName(keys.select("piece", F.lit(1).alias("level"), "start", "end", F.concat(F.lit("LK["), "label", F.lit("]")).alias("label"))).unionByName(inside)


def cadence_sections(labels: DataFrame) -> DataFrame:
    """(piece, seg, start, end, label): sections that end at each cadence, and what is left after the last one.

    Labels are rows (piece, kind, start, duration, tag); positions are whole quarter notes.
    """
    end = labels.groupBy("piece").agg(F.floor(F.max(F.col("start") + F.col("duration"))).cast("int").alias("stop"))
    w = Window.partitionBy("piece").orderBy("start", "tag")
    cut = labels.where("kind = 'cadence'").select("piece", F.floor("start").cast("int").alias("end"), "start", "tag")
    cut = cut.select("piece", (F.row_number().over(w) - 1).alias("seg"), F.coalesce(F.lag("end").over(w), F.lit(0)).alias("start"), "end", F.coalesce("tag", F.lit("")).alias("label"))
    last = cut.groupBy("piece").agg(F.max("end").alias("start"), F.count("*").cast("int").alias("seg"))
    rest = end.join(last, "piece", "left").select("piece", F.coalesce("seg", F.lit(0)).alias("seg"), F.coalesce("start", F.lit(0)).alias("start"), F.col("stop").alias("end"), F.lit("").alias("label"))
    return cut.unionByName(rest.where(F.col("end") > F.col("start")))


def pedals_in_sections(labels: DataFrame) -> DataFrame:
    """(piece, t, start, end): pedals with the first section that holds their start; others drop out."""
    points = labels.where("kind = 'pedal'").select("piece", F.floor("start").cast("int").alias("t")).distinct()
    return joins.first_section(points, cadence_sections(labels).select("piece", "start", "end"), "piece")


def level_spans(events: DataFrame) -> DataFrame:
    """(piece, level, start, end, label): each levelled event up to the next of its level, the last to the piece's end.

    Events are rows (piece, level, t, label, order, total); of events within 1e-9 of each other the last counts.
    """
    t = F.round("t", 9)
    one = events.withColumn("t", t).groupBy("piece", "level", "t", "total").agg(F.max_by("label", "order").alias("label"))
    nxt = F.lead("t").over(Window.partitionBy("piece", "level").orderBy("t"))
    return one.select("piece", "level", F.col("t").alias("start"), F.coalesce(nxt, F.col("total")).alias("end"), "label").where(F.col("end") > F.col("start"))


def boundary_times(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """(piece, level, t): starts strictly inside the piece."""
    return spans.join(totals, "piece").where((F.col("start") > 0) & (F.col("start") < F.col("total"))).select("piece", "level", F.col("start").alias("t")).distinct()


def projection_audit(projected: DataFrame, marks: DataFrame, tolerance: float) -> DataFrame:
    """(piece, marks, edges, collisions, mean_error, max_error, within) of marks moved to edges (piece, t, edge)."""
    n = marks.groupBy("piece").agg(F.count("*").alias("marks"))
    gap = F.abs(F.col("t") - F.col("edge"))
    s = projected.groupBy("piece").agg(F.count("*").alias("rows"), F.countDistinct("edge").alias("edges"), F.avg(gap).alias("mean_error"), F.max(gap).alias("max_error"), F.sum((gap <= tolerance).cast("int")).alias("within"))
    return n.join(s, "piece", "left").select("piece", "marks", F.coalesce("edges", F.lit(0)).alias("edges"), (F.col("marks") - F.coalesce("edges", F.lit(0))).alias("collisions"), "mean_error", "max_error", F.coalesce("within", F.lit(0)).alias("within"))


def bad_bounds(leaves: DataFrame) -> DataFrame:
    """Leaves whose bounds aren't finite, rising, or joined to the next leaf's start; empty for good input."""
    nxt = F.lead("start").over(Window.partitionBy("piece").orderBy("leaf"))
    rows = leaves.withColumn("nxt", nxt)
    wrong = F.isnan("start") | F.isnan("end") | (F.col("end") <= F.col("start")) | (F.abs(F.col("nxt") - F.col("end")) > 1e-9)
    return rows.where(F.coalesce(wrong, F.lit(True)) & (wrong | F.col("start").isNull() | F.col("end").isNull())).select("piece", "leaf", "start", "end")
