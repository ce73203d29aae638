"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine(left: Column, right: Column) -> Column:
    """Cosine over the common prefix; 0 for an empty or a zero vector."""
    a, b = left.cast("array<double>"), right.cast("array<double>")
    size = F.coalesce(F.least(F.size(a), F.size(b)), F.lit(0))
    # zip_with pads the shorter side with nulls, so both are cut first.
    a, b = F.slice(a, F.lit(1), F.greatest(size, F.lit(0))), F.slice(b, F.lit(1), F.greatest(size, F.lit(0)))
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((size > 0) & (norms > 0), _dot(a, b) / F.nullif(norms, F.lit(0.0))).otherwise(0.0)
