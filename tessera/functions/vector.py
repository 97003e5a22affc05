"""Vectors, hashing encoders and percentile rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, added up in double from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def bucket(token: Column, buckets: int) -> Column:
    """A bucket of a token by its MD5, the same in other engines."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def nearest_rank(values: Column, p: float) -> Column:
    """The value at the rounded index p * (n - 1) (ties to even) of the sorted values."""
    s = F.array_sort(values)
    return F.element_at(s, F.rint(F.lit(p) * (F.size(s) - 1)).cast("int") + 1)


def at_share(values: Column, p: float) -> Column:
    """The value at index int(p * n), the last one at most."""
    s = F.array_sort(values)
    return F.element_at(s, F.least(F.size(s) - 1, F.floor(F.lit(p) * F.size(s)).cast("int")) + 1)
