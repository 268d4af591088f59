"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; the shorter vector is padded with zeros."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), 2)), F.lit(0.0), lambda s, x: s + x))


def times(matrix: Column, v: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, v))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))
