"""Column functions on fixed-length vectors (array<double>): norms, embeddings, distances and kernels."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 12
# Probe-tone profiles of the major and minor mode, and the order of pitch classes by fifths.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
FIFTHS = [0, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10, 5]


def rolled(values: list[float], by: int) -> list[float]:
    return [values[(i - by) % len(values)] for i in range(len(values))]


#: Major and minor profile of each tonic in turn.
PROFILES = [rolled(p, t) for t in range(SIZE) for p in (MAJOR, MINOR)]


def constant(values) -> Column:
    """An array literal, nested lists included."""
    return F.array(*(constant(v) if isinstance(v, (list, tuple)) else F.lit(float(v)) for v in values))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def l1_or_uniform(v: Column) -> Column:
    """v over its sum; the uniform vector if the sum isn't positive."""
    return let(total(v), lambda s: F.when(s > 0, scaled(v, s)).otherwise(F.transform(v, lambda x: F.lit(1.0) / F.size(v))))


def l1_or_zero(v: Column) -> Column:
    """v over its sum; zeros if the sum is at most 1e-12."""
    return let(total(v), lambda s: F.when(s > 1e-12, scaled(v, s)).otherwise(F.transform(v, lambda x: F.lit(0.0))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def centred(v: Column) -> Column:
    return let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation, 0 if either vector is constant."""

    def of(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y))), F.lit(0.0))

    return let(centred(a), lambda x: let(centred(b), lambda y: of(x, y)))


def fifths(v: Column) -> Column:
    """The two coordinates of a vector on the circle of fifths."""
    place = {pc: i for i, pc in enumerate(FIFTHS)}
    angles = [2 * math.pi * place[pc] / SIZE for pc in range(SIZE)]
    unit = l1_or_uniform(v)
    return let(unit, lambda u: F.array(dot(u, constant([math.cos(a) for a in angles])), dot(u, constant([math.sin(a) for a in angles]))))


def key_activation(v: Column) -> Column:
    """Correlations with the 24 profiles."""
    rows = [[x - sum(p) / SIZE for x in p] for p in PROFILES]
    units = [[x / math.sqrt(sum(y * y for y in r)) for x in r] for r in rows]

    def of(c: Column) -> Column:
        norm = F.sqrt(dot(c, c))
        return let(norm, lambda n: F.transform(constant(units), lambda u: F.when(n > 0, dot(c, u) / n).otherwise(F.lit(0.0))))

    return let(centred(l1_or_uniform(v)), of)


def global_key(v: Column) -> Column:
    """struct(correlation, tonic, major) of the best profile; ties take the lower tonic, then major."""
    best = lambda act: F.array_max(F.transform(act, lambda x, i: F.struct(x.alias("correlation"), (-F.floor(i / 2)).cast("int").alias("t"), (i % 2 == 0).alias("major"))))
    return let(let(key_activation(v), best), lambda b: F.struct(b["correlation"].alias("correlation"), (-b["t"]).alias("tonic"), b["major"].alias("major")))


def tonic_weights(key: Column) -> Column:
    """The profile of a key, rolled to its tonic, with sum 1."""
    of = lambda p: F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: F.get(constant([x / sum(p) for x in p]), F.pmod(i - key["tonic"], F.lit(SIZE))))
    return F.when(key["major"], of(MAJOR)).otherwise(of(MINOR))


def weighted(v: Column, weights: Column) -> Column:
    return F.zip_with(l1_or_uniform(v), weights, lambda x, w: x * F.sqrt(w))


def transposed(v: Column, by: Column) -> Column:
    return F.transform(v, lambda _, i: F.get(v, F.pmod(i - by, F.size(v))))


#: name -> transform; the distance of a name is the L2 distance of transformed vectors.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "euclidean": l1_or_uniform,
    "circle_of_fifths": fifths,
    "key_profile": key_activation,
    "fixed_weighted": lambda v: weighted(v, constant([x / sum(MAJOR) for x in MAJOR])),
}


def distance(name: str, a: Column, b: Column) -> Column:
    return l2(TRANSFORMS[name](a), TRANSFORMS[name](b))


def mixture(distances: list[Column], weights: list[float], scales: list[float]) -> Column:
    """Convex combination of scaled distances."""
    out = F.lit(0.0)
    for d, w, s in zip(distances, weights, scales, strict=True):
        out = out + d / s * w
    return out


def diagonal(a: Column, b: Column, weights: list[float]) -> Column:
    """Diagonal Mahalanobis distance of vectors with sum 1 (or 0)."""
    terms = F.zip_with(l1_or_zero(a), l1_or_zero(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(dot(terms, constant(weights)))


def rbf(d: Column, scale: Column) -> Column:
    return F.exp(F.lit(-0.5) * (d / scale) * (d / scale))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def span_weight(span: Column, n: Column) -> Column:
    """ln(span) / ln(n), 0 for spans under 2 or over n."""
    return F.when((n < 2) | (span < 2) | (span > n), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.ln(span), F.ln(n)), F.lit(0.0)))
