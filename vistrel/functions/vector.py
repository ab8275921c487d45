"""Vector columns as array<double>: expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """v over its length; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def flip_merge(a: Column, b: Column) -> Column:
    """Sum of the vectors of an image and of its mirror image, normalised."""
    return l2_normalise(F.zip_with(a, b, lambda x, y: x + y))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    """Distance that is safe for rounding below zero."""
    return F.sqrt(F.greatest(squared_distance(a, b), F.lit(0.0)))


def vector_avg(v: Column, dims: int) -> Column:
    """Aggregate: mean per dimension."""
    return F.array(*(F.avg(F.get(v, k)) for k in range(dims)))


def vector_std_mean(v: Column, dims: int) -> Column:
    """Aggregate: population standard deviation per dimension, averaged over dimensions."""
    return sum((F.stddev_pop(F.get(v, k)) for k in range(1, dims)), F.stddev_pop(F.get(v, 0))) / dims
