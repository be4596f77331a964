"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(v: Column) -> Column:
    """The vector at unit length; null for null, empty and zero vectors."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has `dim` values, none null and not all zero."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull()) & F.exists(v, lambda x: x != 0), F.lit(False))
