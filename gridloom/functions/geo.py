"""Coordinates, indices and distance bins as column math."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Albers:
    """Spherical Albers equal-area conic; angles in degrees, lengths in metres."""

    lon0: float = -96.0
    lat0: float = 23.0
    lat1: float = 29.5
    lat2: float = 45.5
    radius: float = 6_371_007.2

    @property
    def n(self) -> float:
        return (math.sin(math.radians(self.lat1)) + math.sin(math.radians(self.lat2))) / 2

    @property
    def c(self) -> float:
        return math.cos(math.radians(self.lat1)) ** 2 + 2 * self.n * math.sin(math.radians(self.lat1))

    @property
    def rho0(self) -> float:
        return self.radius * math.sqrt(self.c - 2 * self.n * math.sin(math.radians(self.lat0))) / self.n

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        rho = F.sqrt(F.lit(self.c) - F.lit(2 * self.n) * F.sin(F.radians(lat))) * (self.radius / self.n)
        theta = F.radians(lon - F.lit(self.lon0)) * self.n
        return rho * F.sin(theta), F.lit(self.rho0) - rho * F.cos(theta)


def to_index(x: Column, y: Column, x0: Column, y0: Column, res: Column) -> tuple[Column, Column]:
    """North-up affine transform: map coordinate -> (row, col)."""
    return F.floor((y0 - y) / res).cast("int"), F.floor((x - x0) / res).cast("int")


def coarse(index: Column, factor: int) -> Column:
    return F.floor(index / F.lit(factor)).cast("int")


def from_colmajor(flat: Column, nrows: int | Column) -> tuple[Column, Column]:
    """1-based column-major position -> 0-based (row, col)."""
    n = nrows if isinstance(nrows, Column) else F.lit(nrows)
    return F.pmod(flat - 1, n).cast("int"), F.floor((flat - 1) / n).cast("int")


def to_colmajor(row: Column, col: Column, nrows: int | Column) -> Column:
    n = nrows if isinstance(nrows, Column) else F.lit(nrows)
    return col.cast("bigint") * n + row + 1


def cell_size_km(res: Column, units: Column) -> Column:
    """Three-branch unit heuristic: metres, degrees, else already km."""
    u = F.lower(units)
    return (
        F.when(u.startswith("met"), res / 1000.0)
        .when(u.startswith("deg"), res * 111.0)
        .otherwise(res)
    )


def log_splits(low: float, high: float, bins: int) -> list[float]:
    """Log-spaced boundaries; the first is opened to 0 and the last to 1e9."""
    start, end = math.log10(max(low, 1.0)), math.log10(high)
    inner = [10 ** (start + (end - start) * i / bins) for i in range(1, bins)]
    return [0.0, *inner, 1e9]


def split_index(x: Column, splits: list[float]) -> Column:
    """0-based index of the bin [splits[i], splits[i+1]) that holds x."""
    index = F.lit(0)
    for boundary in splits[1:-1]:
        index = index + (x >= F.lit(boundary)).cast("int")
    return F.when(x.isNotNull(), index)


def equal_bin(x: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """0-based equal-width bin, right edge closed, outside -> missing."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    raw = F.floor((x - lo) / (hi - lo) * bins).cast("int")
    return F.when((x >= lo) & (x <= hi), F.least(raw, F.lit(bins - 1)))
