"""Vector functions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column, dims: int | None = None) -> Column:
    """Inner product; with a known dimension it is unrolled, so that it stays in generated code."""
    if dims:
        return sum((F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double") for i in range(dims)), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, dims: int | None = None) -> Column:
    return F.sqrt(dot(a, a, dims))


def cosine(a: Column, b: Column, dims: int | None = None) -> Column:
    """0 for empty, unlike-sized or zero vectors."""
    n = norm(a, dims) * norm(b, dims)
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0)
    return F.when(same, dot(a, b, dims) / n).otherwise(0.0)
