"""Column functions on numbers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(text: Column) -> Column:
    """A number written plainly or as a/b; null where it can't be read."""
    parts = F.split(text, "/")
    return F.when(text.contains("/"), F.try_divide(F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double"))).otherwise(text.try_cast("double"))


def work_of(piece: Column) -> Column:
    """The name before its last underscore, or all of it."""
    return F.regexp_replace(piece, "_[^_]*$", "")


def label_bucket(centre: Column, width: Column, total: Column, centres: int, widths: int) -> Column:
    """c{i}w{j}: the buckets of a node's centre and width in a piece of length total."""
    bucket = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x * n / total).cast("int")))
    return F.concat(F.lit("c"), bucket(centre, centres).cast("string"), F.lit("w"), bucket(width, widths).cast("string"))


def close(a: Column, b: Column) -> Column:
    """Equality of floats up to 1e-8 and 1e-5 of b."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def length_weight(n: Column, kind: str) -> Column:
    return {"none": F.lit(1.0), "log1p": F.log1p(n.cast("double")), "linear": n.cast("double")}[kind]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
