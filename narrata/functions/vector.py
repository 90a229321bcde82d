"""Vector scores as Column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where the dimensions differ or a norm is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def similarity(a: Column, b: Column) -> Column:
    """Normalised cosine, (1 + cos) / 2."""
    return (1 + cosine(a, b)) / 2


def distance(a: Column, b: Column) -> Column:
    """Cosine distance, 1 - cos."""
    return 1 - cosine(a, b)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])
