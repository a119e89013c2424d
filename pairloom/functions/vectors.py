"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of ``v``; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda total, x: total + x * x))
    return F.when(norm > 0, F.transform(doubles(v), lambda x: x / norm)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def pair_vector(a: Column, b: Column) -> Column:
    """The pair representation: both vectors, their distance and their product per element."""
    a, b = doubles(a), doubles(b)
    distance = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    product = F.zip_with(a, b, lambda x, y: x * y)
    return F.concat(a, b, distance, product)
