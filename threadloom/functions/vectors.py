"""Vector expressions over arrays of floats, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero or lengths differ, null where one is null."""
    product = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((F.size(a) != F.size(b)) | (product == 0), F.lit(0.0)).otherwise(dot(a, b) / product)


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def parse_vector(text: Column) -> Column:
    """An embedding that came as JSON text; null if it is no list of numbers."""
    return F.from_json(text, "array<float>")
