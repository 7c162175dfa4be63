"""Expressions over ARRAY<DOUBLE> columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_array(values: Sequence[float]) -> Column:
    """Literal ARRAY<DOUBLE> for a coefficient vector of fixed length."""
    return F.array(*[F.lit(float(v)) for v in values])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(x: Column, y: Column) -> Column:
    """Left-to-right inner product; NULL when either vector has a missing element."""
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def complete(x: Column) -> Column:
    """True when no element is missing."""
    return F.forall(x, lambda v: v.isNotNull())


def ruzicka(x: Column, y: Column, floor: float = 1e-6) -> Column:
    """sum(min)/sum(max); 0 for a pair with (almost) no mass."""
    low = total(F.zip_with(x, y, lambda a, b: F.least(a, b)))
    high = total(F.zip_with(x, y, lambda a, b: F.greatest(a, b)))
    return F.when(high > floor, low / high).otherwise(F.lit(0.0))
