"""Vector functions on arrays of floats, summed up in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2norm(v: Column) -> Column:
    """The vector over its length, which counts as 1e-8 at least."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-8))
    return F.transform(v, lambda x: x.cast("double") / length)


def clipped_z(x: Column, mean: Column, deviation: Column, n: Column, cap: float = 3.0) -> Column:
    """(x - mean) / deviation within 0 and cap, over cap; 0 for fewer than two rows or next to no spread."""
    z = (x - mean) / F.when(deviation < 1e-6, None).otherwise(deviation)
    return F.when((n < 2) | (deviation < 1e-6) | x.isNull(), 0.0).otherwise(F.least(F.greatest(z, F.lit(0.0)), F.lit(float(cap))) / float(cap))


def mean_vector(column: str, size: int) -> Column:
    """Aggregate: the mean of each dimension as an array, in one pass with map-side sums."""
    return F.array(*(F.avg(F.get(F.col(column), F.lit(i)).cast("double")) for i in range(size)))


def sum_vector(column: str, size: int) -> Column:
    """Aggregate: the sum of each dimension as an array."""
    return F.array(*(F.sum(F.get(F.col(column), F.lit(i)).cast("double")) for i in range(size)))
