"""Link functions, clips and power transforms."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """Bounded x; greatest/least alone would turn a missing value into a bound."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1+e^x) without overflow for large x."""
    return (F.abs(x) + x) / 2 + F.log1p(F.exp(-F.abs(x)))


def positive_link(x: Column, link: str = "softplus") -> Column:
    """Map a linear predictor to a positive rate."""
    if link == "softplus":
        return softplus(x)
    if link == "exp":
        return F.exp(x)
    raise ValueError(f"unknown link {link!r}")


def power(x: Column, exponent: float, negatives: str = "missing") -> Column:
    """x^p keeping zeros; negatives become missing or are clipped to zero."""
    if not 0 < exponent <= 1:
        raise ValueError("exponent must be in (0, 1]")
    if negatives == "clip":
        return F.when(x < 0, F.lit(0.0)).otherwise(F.pow(x, F.lit(exponent)))
    return F.when(x >= 0, F.pow(x, F.lit(exponent)))
