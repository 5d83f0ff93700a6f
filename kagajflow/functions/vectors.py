"""Vector arithmetic on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, digits: int | None = None) -> Column:
    """Cosine similarity; null for a null or all-zero vector."""
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return value if digits is None else F.round(value, digits)
