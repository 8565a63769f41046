"""Vector arithmetic on array columns, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a side is null or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(a: Column, least: float = 1e-9) -> Column:
    length = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / length)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
