"""Vector functions as Column expressions, accumulated in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """c to so many digits by way of a whole number, as SQL engines round doubles: F.round() goes by a double's shortest decimals, and so takes 0.5047875 up that lies below its tie."""
    unit = float(10**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(unit)) / F.lit(unit)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def unit(v: Column) -> Column:
    """v over its length; null for an empty or zero vector."""
    n = norm(v)
    return F.when((F.size(v) > 0) & (n > 0), F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """-1 to 1; null where lengths differ, or either is empty or zero."""
    below = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (below > 0), dot(a, b) / below)


def quantized(v: Column, low: Column, high: Column) -> Column:
    """Whole numbers 0 to 255, cut off and not rounded; low and high are the document's."""
    scale = quantum(low, high)
    return F.transform(v, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), ((x.cast("double") - low) / scale).cast("int"))))


def quantum(low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-6, F.lit(1e-6)).otherwise(high - low) / F.lit(255.0)


def dequantized(q: Column, low: Column, high: Column) -> Column:
    scale = quantum(low, high)
    return F.transform(q, lambda x: x * scale + low)
