"""Vectors: similarity, truncation and the float32 codec."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Double accumulation; 0 for a zero vector; lengths that differ raise."""
    product = norm(a) * norm(b)
    got = F.when(product > 0, dot(a, b) / product).otherwise(F.lit(0.0))
    return F.when(F.size(a) == F.size(b), got).otherwise(F.raise_error("vectors differ in length").cast("double"))


def truncated(a: Column, dims: int) -> Column:
    """The first ``dims`` numbers, to unit length."""
    head = F.slice(a, 1, dims)
    scaled = lambda n: F.transform(head, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    # The norm is bound once, not computed for each number.
    return F.get(F.transform(F.array(norm(head)), scaled), F.lit(0))


def pack(vector: list[float]) -> bytes:
    return struct.pack(f"<{len(vector)}f", *vector)


def unpack(data: bytes) -> list[float]:
    if len(data) % 4:
        raise ValueError("a packed vector has four bytes for each number")
    return list(struct.unpack(f"<{len(data) // 4}f", data))
