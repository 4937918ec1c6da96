"""Vectors as arrays of doubles: higher-order functions, no user code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda acc, d: acc + d * d))


def half_cosine(a: Column, b: Column) -> Column:
    """Half the cosine distance: 0 for the same direction, 1 for opposite ones."""
    return F.lit(0.5) - cosine(a, b) / 2


def absolute(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def falling(a: Column, b: Column) -> Column:
    """How far the later value lies below the earlier."""
    return a - b


def rising(a: Column, b: Column) -> Column:
    """How far the later value lies above the earlier."""
    return b - a


def is_zero(v: Column) -> Column:
    """Whether all components are zero."""
    return F.forall(v, lambda x: x == 0)


def mean_of(vectors: Column, size: int) -> Column:
    """Component-wise mean of an array of vectors of ``size`` components."""
    zero = F.array_repeat(F.lit(0.0), size)
    return scaled(F.aggregate(vectors, zero, lambda acc, v: added(acc, v)), F.lit(1.0) / F.size(vectors))


def spread_of(vectors: Column, size: int) -> Column:
    """Mean over the components of their population standard deviation."""
    mean = mean_of(vectors, size)
    square = F.aggregate(vectors, F.array_repeat(F.lit(0.0), size), lambda acc, v: F.zip_with(acc, F.zip_with(v, mean, lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), lambda s, d: s + d))
    return total(F.transform(square, lambda s: F.sqrt(s / F.size(vectors)))) / size
