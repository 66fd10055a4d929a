"""Float vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def all_finite(vector: Column) -> Column:
    return F.forall(vector, finite)


def _sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double"))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def root_normalised(vector: Column) -> Column:
    """Square roots of the shares of the sum; zeros where the sum is 0."""
    total = _sum(vector)
    return F.transform(vector, lambda x: F.when(total > 0, F.sqrt(x.cast("double") / total)).otherwise(F.lit(0.0)))


def canonical_matrix(m: Column) -> Column:
    """A matrix (array) divided by its norm, the sign making the first element of largest magnitude positive."""
    norm = F.sqrt(_sum(F.transform(m, lambda x: x * x)))
    largest = F.array_max(F.transform(m, lambda x: F.abs(x)))
    lead = F.element_at(F.filter(m, lambda x: F.abs(x) == largest), 1)
    sign = F.when(lead < 0, -1.0).otherwise(1.0)
    return F.when(norm > 0, F.transform(m, lambda x: x * sign / norm + F.lit(0.0)))
