"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def is_valid(v: Column, dimension: int, tolerance: float = 2e-4) -> Column:
    """Whether a vector has the dimension, only finite numbers and unit length."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite & (F.abs(norm(v) - 1) <= tolerance), F.lit(False))


def score_of(similarity: Column) -> Column:
    """A similarity from -1 to 1 as a score from 0 to 1, to six places; null for what is not a finite number."""
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity))
    return F.when(F.isnan(similarity) | (F.abs(similarity) == float("inf")), None).otherwise(F.round((bounded + 1) / 2, 6))
