"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; NULL when either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    return F.lit(1.0) - cosine(a, b)
