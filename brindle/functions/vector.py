"""Vector functions as column expressions, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is empty or has no length, or the sizes differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def on_axis(value: Column, low: Column, high: Column) -> Column:
    """A value's place between low and high, 0 to 1; the middle where they are equal."""
    return F.when(high == low, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low))))
