"""Grid geometry: coarsening, regridding, sampling, bases."""
from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import coarse


def block_reduce(df: DataFrame, factor: int, nrows: Column, ncols: Column, how: str = "mean", keys: Sequence[str] = (), column: str = "value") -> DataFrame:
    """Block mean or max ignoring missing values; incomplete edge blocks are trimmed."""
    agg = {"mean": F.avg, "max": F.max}[how]
    inside = (F.col("row") < F.floor(nrows / factor) * factor) & (F.col("col") < F.floor(ncols / factor) * factor)
    return (
        df.where(inside)
        .groupBy(*keys, coarse(F.col("row"), factor).alias("row"), coarse(F.col("col"), factor).alias("col"))
        .agg(agg(column).alias(column))
    )


def block_quantiles(df: DataFrame, factor: int, probs: Sequence[float], keys: Sequence[str] = (), column: str = "value") -> DataFrame:
    """(keys, row, col, band, value): exact quantiles of each factor x factor block.

    A block is reduced to (value, count) before its quantiles are taken; all-missing
    blocks keep their bands with missing values.
    """
    block = [*keys, coarse(F.col("row"), factor).alias("row"), coarse(F.col("col"), factor).alias("col")]
    counted = df.groupBy(*block, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    quantiles = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]), F.col("_n"))
    arrays = counted.groupBy(*keys, "row", "col").agg(F.coalesce(quantiles, F.array_repeat(F.lit(None).cast("double"), len(probs))).alias("_q"))
    return arrays.select(*keys, "row", "col", F.posexplode("_q").alias("band", column)).withColumn("band", F.col("band") + 1)


def nearest_regrid(target: DataFrame, source: DataFrame, ratio: float, column: str) -> DataFrame:
    """Value of the source cell under each target cell centre (``ratio`` source cells per target cell)."""
    at = target.withColumns({
        "_r": F.floor((F.col("row") + 0.5) * ratio).cast("int"),
        "_c": F.floor((F.col("col") + 0.5) * ratio).cast("int"),
    })
    src = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), column)
    return at.join(src, ["_r", "_c"], "left").drop("_r", "_c")


def bilinear_regrid(target: DataFrame, source: DataFrame, ratio: float, column: str = "value") -> DataFrame:
    """Bilinear value at each target centre, re-weighted over the non-missing corners."""
    y, x = (F.col("row") + 0.5) * ratio - 0.5, (F.col("col") + 0.5) * ratio - 0.5
    r0, c0 = F.floor(y).cast("int"), F.floor(x).cast("int")
    fy, fx = y - F.floor(y), x - F.floor(x)
    corners = F.explode(F.array(*[
        F.struct((r0 + dr).alias("_r"), (c0 + dc).alias("_c"), ((fy if dr else 1 - fy) * (fx if dc else 1 - fx)).alias("_w"))
        for dr, dc in itertools.product((0, 1), repeat=2)
    ]))
    src = source.where(F.col(column).isNotNull()).select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(column).alias("_v"))
    spread = target.select("row", "col", corners.alias("_k")).select("row", "col", "_k.*").where("_w > 0")
    return (
        spread.join(src, ["_r", "_c"], "left")
        .groupBy("row", "col")
        .agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")))).alias(column))
    )


def sample_points(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Raster values at points that already carry (row, col); off-grid points stay missing."""
    return points.join(grid, ["row", "col"], "left")


def cosine_waves(n: int, t: Column) -> list[Column]:
    return [F.cos(F.lit(k * math.pi) * t) for k in range(n + 1)]


def cosine_terms(n_time: int, n_space: int) -> list[tuple[int, int, int]]:
    """(k, i, j) of the space-time cosine basis, constant term skipped."""
    every = itertools.product(range(n_time + 1), range(n_space + 1), range(n_space + 1))
    return [t for t in every if t != (0, 0, 0)]


def cosine_basis(df: DataFrame, t: Column, y: Column, x: Column, n_time: int, n_space: int) -> DataFrame:
    """One row per cell-time and basis function; coordinates are scaled to [0, 1]."""
    tw, yw, xw = cosine_waves(n_time, t), cosine_waves(n_space, y), cosine_waves(n_space, x)
    terms = [
        F.struct(F.lit(b).alias("b"), (tw[k] * (yw[i] * xw[j])).alias("phi"))
        for b, (k, i, j) in enumerate(cosine_terms(n_time, n_space))
    ]
    return df.select("*", F.explode(F.array(*terms)).alias("_t")).select(*df.columns, "_t.b", "_t.phi")


def cosine_projection(df: DataFrame, t: Column, y: Column, x: Column, n_time: int, n_space: int, weights: Sequence[float], name: str) -> DataFrame:
    """sum_b phi_b * w_b per row: (n_time + 2 n_space + 3) cosines, nothing exploded or shuffled."""
    terms = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("w"))
        for (k, i, j), w in zip(cosine_terms(n_time, n_space), weights, strict=True)
    ])
    at = df.withColumns({"_t": t, "_y": y, "_x": x})
    waves = F.struct(
        F.array(*cosine_waves(n_time, F.col("_t"))).alias("t"),
        F.array(*cosine_waves(n_space, F.col("_y"))).alias("y"),
        F.array(*cosine_waves(n_space, F.col("_x"))).alias("x"),
    )
    # the one-element array makes the waves a value that is computed once per row
    total = F.transform(F.array(waves), lambda v: F.aggregate(
        terms, F.lit(0.0), lambda acc, b: acc + v["t"][b["k"]] * (v["y"][b["i"]] * v["x"][b["j"]]) * b["w"]
    ))[0]
    return at.withColumn(name, total).drop("_t", "_y", "_x")
