"""Vector functions: column expressions for single pairs, a numpy matrix product for batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision, over the shorter length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    d = norm(x) * norm(y)
    return F.when(d == 0, 0.0).otherwise(dot(x, y) / d)


def softmax_loss(logits: Column, target: Column) -> Column:
    """Cross-entropy with the maximum shifted out."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.log(total) + top - F.get(logits, target).cast("double")
