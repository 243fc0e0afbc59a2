"""Vector maths on arrays of three coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minus(a: Column, b: Column) -> Column:
    return F.array(*[a[i] - b[i] for i in range(3)])


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Column) -> Column:
    """The length of a vector; null for one too short to have a direction."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 1e-12, n)


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1, null if either vector has no direction."""
    value = dot(a, b) / (norm(a) * norm(b))
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))


def angle(cos: Column) -> Column:
    return F.degrees(F.acos(cos))


def folded(degrees: Column) -> Column:
    """The angle between lines instead of directions: at most 90 degrees."""
    return F.least(degrees, 180 - degrees)
