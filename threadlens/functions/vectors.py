"""Array and vector helpers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense arrays; 0 when one of them is a zero vector."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def as_vector(array: Column) -> Column:
    return array_to_vector(array.cast("array<double>"))


def sparse_entries(vector: Column) -> Column:
    """(index, value) pairs stored in a sparse vector column."""
    raw = F.unwrap_udt(vector)
    return F.arrays_zip(raw["indices"].alias("index"), raw["values"].alias("value"))
