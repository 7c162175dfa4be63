"""Variograms over all pairs of cells within a distance, without a row per pair.

Pairs at one offset (dr, dc) are one entry of the correlation of the field with itself. Each tile correlates its own cells
with its cells and a halo of the radius by fast Fourier transforms, a few dimensions of the vector at a time, and gives
one row per offset; Spark adds the rows of all tiles. So the work follows cells x log(radius), and what leaves a tile is its
offsets. Sums of a tile are right up to about 1e-15 times the product of the lengths of both its fields; counts are exact.

Rows without a place or with a missing or infinite number in the vector (or no vector) are left out. Rows of one
cell all count, but not as pairs with each other: they are added up before any tile sees them.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 64
#: Dimensions of the vector that a tile's task holds at once.
DIMS = 8


def _fast(n: int) -> int:
    """The next length whose only prime factors are 2, 3 and 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def offsets(radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(dr, dc) of one of each two opposite offsets, other than 0, within the radius."""
    r = int(radius)
    dr, dc = np.mgrid[0:r + 1, -r:r + 1]
    take = ((dr > 0) | (dc > 0)) & (dr * dr + dc * dc <= radius * radius)
    return dr[take], dc[take]


def correlate(first: Sequence[np.ndarray], second: Sequence[np.ndarray], radius: int, dr: np.ndarray, dc: np.ndarray) -> np.ndarray:
    """sum over fields and places p of first[p] * second[p + (dr, dc)]. Fields share a shape whose last ``radius`` rows, and first
    and last ``radius`` columns, are 0 in ``first``, so nothing wraps around."""
    shape = tuple(_fast(n) for n in first[0].shape)
    total = 0.0
    for a, b in zip(first, second):
        total = total + np.conj(np.fft.rfft2(a, shape)) * np.fft.rfft2(b, shape)
    return np.fft.irfft2(total, shape)[dr, dc]


def _cells(df: DataFrame, vector: str, dims: int, layers: Sequence[str]) -> DataFrame:
    """One row per layer, cell and part of the vector: how many rows the cell has, the sums of their numbers and of their squares."""
    z = F.transform(F.slice(vector, 1, dims), lambda x: x.cast("double"))
    finite = F.forall(z, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    known = df.where(F.col("row").isNotNull() & F.col("col").isNotNull() & (F.size(vector) >= dims) & finite)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(dims - 1), F.lit(DIMS)), lambda i: F.slice(z, i + 1, F.lit(DIMS)))
    numbers = [F.coalesce(F.get("_z", F.lit(i)), F.lit(0.0)) for i in range(DIMS)]
    square = F.aggregate("_z", F.lit(0.0), lambda a, x: a + x * x)
    return known.select(*layers, "row", "col", F.posexplode(pieces).alias("_part", "_z")).groupBy(*layers, "row", "col", "_part").agg(
        F.count("*").cast("double").alias("_n"), F.sum(square).alias("_q"), *[F.sum(x).alias(f"_v{i}") for i, x in enumerate(numbers)])


def lag_sums(df: DataFrame, vector: str, dims: int, radius: float, layers: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(layers, dr, dc, n, dot, squares) of every offset within ``radius`` that a pair has, one of each two opposite ones.

    ``df`` has row, col (integers) and ``vector`` (an array of ``dims`` numbers). n counts the pairs of rows z, z' at that
    offset, dot sums z . z', squares sums z . z + z' . z'.
    """
    layers, r = list(layers), int(radius)
    edge = max(tile, 2 * r)
    height, width = edge + r, edge + 2 * r
    # a pair belongs to the tile of its upper cell, so tiles look down and to both sides
    placed = _cells(df, vector, dims, layers)
    placed = placed.withColumn("_tr", F.explode(F.sequence(F.floor((F.col("row") - r) / edge), F.floor(F.col("row") / edge))))
    placed = placed.withColumn("_tc", F.explode(F.sequence(F.floor((F.col("col") - r) / edge), F.floor((F.col("col") + r) / edge))))
    types = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([T.StructField(c, types[c]) for c in layers] + [T.StructField(c, T.IntegerType()) for c in ("dr", "dc")]
                          + [T.StructField("n", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("dot", "squares")])
    dr, dc = offsets(radius)

    def one_tile(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        *_, tr, tc, part = key
        at = (pdf["row"].to_numpy() - tr * edge, pdf["col"].to_numpy() - tc * edge + r)

        def plane(name: str) -> tuple[np.ndarray, np.ndarray]:
            """The tile's own cells, and those with the halo."""
            whole = np.zeros((height, width))
            whole[at] = pdf[name].to_numpy()
            own = np.zeros_like(whole)
            own[:edge, r:r + edge] = whole[:edge, r:r + edge]
            return own, whole

        count, square = plane("_n"), plane("_q")
        n = np.rint(correlate(count[:1], count[1:], r, dr, dc)).astype(np.int64)
        squares = correlate([square[0], count[0]], [count[1], square[1]], r, dr, dc)
        dot = correlate(*zip(*(plane(f"_v{i}") for i in range(DIMS))), r, dr, dc)
        some = n > 0
        out = {c: np.repeat(pdf[c].iloc[:1], some.sum()).to_numpy() for c in layers}
        out |= {"dr": dr[some], "dc": dc[some], "n": n[some] if part == 0 else np.zeros(some.sum(), np.int64), "dot": dot[some], "squares": squares[some]}
        return pd.DataFrame(out)

    sums = placed.groupBy(*layers, "_tr", "_tc", "_part").applyInPandas(one_tile, schema)
    return sums.groupBy(*layers, "dr", "dc").agg(*[F.sum(c).alias(c) for c in ("n", "dot", "squares")])


def _distance() -> Column:
    return F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))


def turnover(df: DataFrame, vector: str, dims: int, radius: float, width: float, layers: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(layers, bin, n, turnover, semivariance, slope): of all pairs in each distance bin of ``width`` the number, the mean of
    1 - z . z' and half the mean squared difference; slope is the layer's regression of 1 - z . z' on distance over all pairs
    within ``radius``, missing if they all have one distance."""
    layers = list(layers)
    lags = lag_sums(df, vector, dims, radius, layers, tile).withColumn("_d", _distance())
    bins = lags.groupBy(*layers, F.floor(F.col("_d") / width).cast("int").alias("bin")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - F.col("dot")).alias("_e"), F.sum(F.col("squares") - 2 * F.col("dot")).alias("_s"),
        F.sum(F.col("n") * F.col("_d")).alias("_nd"), F.sum(F.col("n") * F.col("_d") * F.col("_d")).alias("_ndd"), F.sum((F.col("n") - F.col("dot")) * F.col("_d")).alias("_ed"))
    total = bins.groupBy(*layers).agg(*[F.sum(c).alias(f"_t{c}") for c in ("n", "_e", "_nd", "_ndd", "_ed")])
    spread = F.col("_tn") * F.col("_t_ndd") - F.col("_t_nd") * F.col("_t_nd")
    slope = F.when(spread > 1e-9 * F.col("_t_nd") * F.col("_t_nd"), (F.col("_tn") * F.col("_t_ed") - F.col("_t_nd") * F.col("_t_e")) / spread)
    trend = total.select(*layers, slope.alias("slope"))
    if layers:
        same = [F.col(f"_b.{c}").eqNullSafe(F.col(f"_t.{c}")) for c in layers]
        joined = bins.alias("_b").join(trend.alias("_t"), same).select(*[F.col(f"_b.{c}") for c in layers], "bin", "n", "_e", "_s", "slope")
    else:
        joined = bins.withColumn("slope", trend.scalar())
    return joined.select(*layers, "bin", "n", (F.col("_e") / F.col("n")).alias("turnover"), (F.col("_s") / F.col("n") / 2).alias("semivariance"), "slope")
