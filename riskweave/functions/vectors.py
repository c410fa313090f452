"""Vector Columns over ``array<float>`` and the stored byte form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Dot product; NULL when the sizes differ (a shortened comparison would be a wrong one)."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.when(
        F.size(left) == F.size(right), F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    )


def normalise(vector: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(length == 0.0, doubles).otherwise(F.transform(doubles, lambda x: x / length))


def is_readable(vector: Column, dimensions: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dimensions) & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double"))
    )
