"""Vector arithmetic as Column expressions (double precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays; members beyond the shorter one count as null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has length zero or the sizes differ."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def quantize(v: Column) -> Column:
    """Affine int8 codes: struct(codes, min, scale, self_dot).

    A code is round-half-even((x - min) * 255 / range) - 128, within the byte
    range; a constant vector has range 1.
    """
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    width = F.when(high > low, high - low).otherwise(F.lit(1.0))
    codes = F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint((x.cast("double") - low) * 255 / width) - 128)).cast("int"))
    return F.struct(codes.alias("codes"), low.alias("min"), (width / 255).alias("scale"), dot(codes, codes).cast("long").alias("self_dot"))


def centroid(values: Column) -> Column:
    """Element-wise mean of an array of equally long arrays."""
    size = F.size(values)
    total = F.aggregate(values, F.transform(values[0], lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / size)
