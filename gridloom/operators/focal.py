"""Neighbourhood operators: kernels as offset tables, applied to tiles with a halo.

A cell sends w(d) * value to the cell at offset d. Every input cell is copied into the tiles
whose halo holds it; a tile is convolved on its own with numpy matrix products (sums of
products only, so nothing turns negative beside a large value) and no sums cross tiles. The
tile edge follows the radius. ``scatter`` is the same for small constant stencils, in SQL.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Smallest tile edge; wide kernels use tiles of twice their radius.
TILE = 64
#: Kernel bytes one broadcast may hold; a larger stack is applied in parts.
KERNEL_BYTES = 64 << 20

Offsets = list[tuple[int, int, float]]

# -- kernel tables ---------------------------------------------------------------


def box(size: int = 5) -> Offsets:
    r = size // 2
    return [(dr, dc, 1.0) for dr in range(-r, r + 1) for dc in range(-r, r + 1)]


def gamma_scale(mean_distance: float, shape: float) -> float:
    """Scale of exp(-(d/scale)^shape) whose mean displacement is ``mean_distance``."""
    return mean_distance * math.gamma(2.0 / shape) / math.gamma(3.0 / shape)


def isotropic(radius: int, cell_size: float, mean_distance: float, shape: float) -> Offsets:
    """exp(-(d/scale)^shape) on the square |d| <= radius, summing to 1."""
    scale = gamma_scale(mean_distance, shape)
    span = range(-radius, radius + 1)
    raw = [(dr, dc, math.exp(-((math.hypot(dr, dc) * cell_size / scale) ** shape))) for dr in span for dc in span]
    mass = sum(w for _, _, w in raw)
    return [(dr, dc, w / mass) for dr, dc, w in raw]


#: Fixed bearings in grid coordinates (rows grow southwards).
BEARINGS = {"to_NORTH": -math.pi / 2, "to_SOUTH": math.pi / 2, "to_EAST": 0.0, "to_WEST": math.pi}


def direction_weight(dr: int, dc: int, bearing: float, origin: str = "split") -> float:
    """cos^2 of the angle to the bearing within 90 degrees; the origin is shared or counted fully."""
    if dr == 0 and dc == 0:
        return 0.25 if origin == "split" else 1.0
    turn = (math.atan2(dr, dc) - bearing + math.pi) % (2 * math.pi) - math.pi
    return math.cos(min(abs(turn), math.pi / 2)) ** 2


def directional(base: Offsets, splits: Sequence[float], cell_size: float, smooth: float | None = None, origin: str = "split") -> dict[str, Offsets]:
    """Split a base kernel into direction x distance bands that add up to it (origin='split')."""
    slope = 4.0 / (smooth if smooth is not None else 2.0 * cell_size)

    def beyond(distance: float, boundary: float) -> float:
        if boundary <= 1e-6:
            return 1.0
        if boundary >= 1e9:
            return 0.0
        return 1.0 / (1.0 + math.exp(-slope * (distance - boundary)))

    stack = {}
    for name, bearing in BEARINGS.items():
        for lo, hi in zip(splits, splits[1:]):
            band = []
            for dr, dc, w in base:
                d = math.hypot(dr, dc) * cell_size
                band.append((dr, dc, w * direction_weight(dr, dc, bearing, origin) * (beyond(d, lo) - beyond(d, hi))))
            stack[f"{name}_{lo:.0f}-{hi:.0f}"] = band
    return stack


def normalized(offsets: Offsets) -> Offsets:
    mass = sum(w for _, _, w in offsets)
    return [(dr, dc, w / mass) for dr, dc, w in offsets] if mass > 1e-12 else offsets


def resize_weights(size: int, new: int) -> np.ndarray:
    """(new, size) weights of bilinear resampling with antialiasing; rows sum to 1."""
    step = size / new
    at = (np.arange(new) + 0.5) * step - 0.5
    raw = np.maximum(0.0, 1.0 - np.abs(at[:, None] - np.arange(size)[None, :]) / max(step, 1.0))
    return raw / raw.sum(1, keepdims=True)


def shrunk(offsets: Offsets, part: int, steps: int, frame: int) -> Offsets:
    """The kernel, centred in a square of ``frame`` cells, shrunk bilinearly to part/steps of its
    size; mass is preserved. Empty when nothing of the frame is left."""
    new = frame * part // steps
    radius = max(max(abs(dr), abs(dc)) for dr, dc, _ in offsets)
    if 2 * radius >= frame:
        raise ValueError("the frame must hold the kernel")
    if new < 1:
        return []
    centre = frame // 2
    used = resize_weights(frame, new)[:, centre - radius:centre + radius + 1]
    grid = used @ _kernel_grid(offsets, radius, False) @ used.T
    mass = grid.sum()
    if mass <= 1e-9:
        return []
    grid *= sum(w for _, _, w in offsets) / mass
    shift = (frame - new) // 2 - centre
    return [(int(i) + shift, int(j) + shift, float(grid[i, j])) for i, j in np.argwhere(grid != 0.0)]


def inverse_distance(radius: float) -> Offsets:
    r = int(radius)
    cells = [(dr, dc) for dr in range(-r, r + 1) for dc in range(-r, r + 1) if 0 < math.hypot(dr, dc) <= radius]
    return [(dr, dc, 1.0 / math.hypot(dr, dc)) for dr, dc in cells]


def kernel_table(spark, stack: dict[str, Offsets]) -> DataFrame:
    """(kernel, dr, dc, w): parameter-sized table for reports."""
    rows = [(k, dr, dc, float(w)) for k, offsets in stack.items() for dr, dc, w in offsets]
    return spark.createDataFrame(rows, "kernel STRING, dr INT, dc INT, w DOUBLE")


def gaussian_weights(sigma: float) -> list[float]:
    """Weights for d = -r..r with r = int(4 sigma + 0.5), normalised."""
    r = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


# -- application -----------------------------------------------------------------


def cluster(df: DataFrame, layers: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Bring neighbouring cells of a layer into one task (a tile has at most tile^2 cells)."""
    return df.repartition(*layers, F.floor(F.col("row") / tile), F.floor(F.col("col") / tile))


def _offset_sql(offsets: Offsets, mirrored: bool, kernel: int | None = None) -> str:
    """Offset table as one constant array expression (folded once by the optimizer)."""
    sign = -1 if mirrored else 1
    tag = f"'k', {kernel}, " if kernel is not None else ""
    items = [f"named_struct({tag}'dr', {sign * dr}, 'dc', {sign * dc}, 'w', {float(w)!r}D)" for dr, dc, w in offsets if w != 0.0]
    return f"array({', '.join(items)})"


def scatter(df: DataFrame, stack: dict[str, Offsets], values: Sequence[str], layers: Sequence[str] = (), mirrored: bool = False) -> DataFrame:
    """(layers, kernel, row, col, values): offset form, every kernel applied to every row.

    Kernels travel as small integers and get their names back after the sums.
    """
    names = list(stack)
    offsets = F.expr(f"concat({', '.join(_offset_sql(stack[k], mirrored, i) for i, k in enumerate(names))})")
    sent = cluster(df, layers).withColumn("_o", F.explode(offsets)).select(
        *layers, F.col("_o.k").alias("_k"), (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col"),
        *[(F.col("_o.w") * F.col(v)).alias(v) for v in values],
    )
    sums = sent.groupBy(*layers, "_k", "row", "col").agg(*[F.sum(v).alias(v) for v in values])
    label = F.element_at(F.array(*[F.lit(k) for k in names]), F.col("_k") + 1)
    return sums.select(*layers, label.alias("kernel"), "row", "col", *values)


def _kernel_grid(offsets: Offsets, radius: int, mirrored: bool) -> np.ndarray:
    g = np.zeros((2 * radius + 1, 2 * radius + 1))
    sign = -1 if mirrored else 1
    for dr, dc, w in offsets:
        g[sign * dr + radius, sign * dc + radius] += w
    return g


def _products(block: np.ndarray, grid: np.ndarray, edge: int) -> np.ndarray:
    """Inner edge x edge part of the convolution of (values, edge + 2r, edge + 2r) blocks."""
    radius = grid.shape[0] // 2
    out = np.zeros((len(block), edge, edge))
    lag = np.arange(edge)[None, :] - np.arange(edge + 2 * radius)[:, None] + 2 * radius
    inside = (lag >= 0) & (lag <= 2 * radius)
    lag = np.where(inside, lag, 0)
    for i in np.flatnonzero(grid.any(1)):
        band = np.where(inside, grid[i][lag], 0.0)
        top = 2 * radius - i
        out += block[:, top:top + edge] @ band
    return out


def _parts(stack: dict[str, Offsets], radius: int) -> list[dict[str, Offsets]]:
    """The stack in parts whose dense kernels fit one broadcast."""
    names, per = list(stack), max(1, KERNEL_BYTES // (8 * (2 * radius + 1) ** 2))
    return [{k: stack[k] for k in names[i:i + per]} for i in range(0, len(names), per)]


def _radius(stack: dict[str, Offsets]) -> int:
    return max((max(abs(dr), abs(dc)) for o in stack.values() for dr, dc, _ in o), default=0)


def _edge(radius: int, tile: int) -> int:
    return max(tile, 2 * radius, 1)


def in_tiles(df: DataFrame, radius: int, edge: int) -> DataFrame:
    """Each row once per tile whose halo holds its cell: adds _tr, _tc."""
    for name, at in (("_tr", "row"), ("_tc", "col")):
        lo, hi = F.floor((F.col(at) - radius) / edge), F.floor((F.col(at) + radius) / edge)
        df = df.withColumn(name, F.explode(F.sequence(lo, hi)))
    return df


def _fill(pdf: pd.DataFrame, tr: int, tc: int, values: Sequence[str], radius: int, edge: int) -> np.ndarray:
    """(2 * values + 1) planes of a tile with halo: values, where they are known, where a row is."""
    side = edge + 2 * radius
    at = (pdf["row"].to_numpy() - (tr * edge - radius), pdf["col"].to_numpy() - (tc * edge - radius))
    planes = np.zeros((2 * len(values) + 1, side, side))
    for i, v in enumerate(values):
        x = pdf[v].to_numpy(dtype=float)
        known = ~np.isnan(x)
        planes[i][at] = np.where(known, x, 0.0)
        planes[len(values) + i][at] = known
    planes[-1][at] = 1.0
    return planes


def gather(df: DataFrame, stack: dict[str, Offsets], values: Sequence[str], layers: Sequence[str] = (), mirrored: bool = False, by_kernel: bool = False, unique: bool = False, tile: int = TILE) -> DataFrame:
    """(layers, kernel, row, col, values): sums of w * value over the rows a kernel brings to a cell.

    Any cell reached with a weight other than 0 is a row. Missing values are left out of a sum, and a sum
    of missing values only is missing. ``by_kernel``: rows already name the kernel they use; else
    every kernel is applied. ``unique``: at most one row per layer, kernel and cell, so the sums
    that keep a tile small (and their shuffle) are not needed. Values are finite or missing.
    """
    parts = _parts(stack, _radius(stack))
    if len(parts) > 1:
        if by_kernel:
            pick = [df.where(F.col("kernel").isin(list(p))) for p in parts]
        else:
            pick = [df] * len(parts)
        out = [gather(d, p, values, layers, mirrored, by_kernel, unique, tile) for d, p in zip(pick, parts)]
        for other in out[1:]:
            out[0] = out[0].unionByName(other)
        return out[0]
    layers, values, names, radius = list(layers), list(values), list(stack), _radius(stack)
    edge = _edge(radius, tile)
    kernels = df.sparkSession.sparkContext.broadcast([_kernel_grid(stack[k], radius, mirrored) for k in names])
    code = F.array_position(F.array(*[F.lit(k) for k in names]), F.col("kernel")).cast("int") - 1 if by_kernel else F.lit(-1)
    cells = df.withColumn("_k", code).select(*layers, "_k", "row", "col", *[F.col(v).cast("double").alias(v) for v in values])
    if not unique:
        cells = cells.groupBy(*layers, "_k", "row", "col").agg(*[F.sum(v).alias(v) for v in values])
    types = {f.name: f.dataType for f in df.schema}
    schema = T.StructType(
        [T.StructField(c, types[c]) for c in layers] + [T.StructField("_k", T.IntegerType())]
        + [T.StructField(c, types[c]) for c in ("row", "col")] + [T.StructField(v, T.DoubleType()) for v in values]
    )

    def one_tile(key: tuple, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        *layer, code, tr, tc = key
        tr, tc, n = int(tr), int(tc), len(values)
        planes = _fill(pdf, tr, tc, values, radius, edge)
        whole = bool((planes[n:2 * n] == planes[-1]).all())  # nothing missing: one count serves all
        for k in [int(code)] if code >= 0 else range(len(kernels.value)):
            grid = kernels.value[k]
            sums = _products(planes[:n], grid, edge)
            hits = np.rint(_products(planes[-1:] if whole else planes[n:], (grid != 0.0).astype(float), edge))
            rr, cc = np.nonzero(hits[-1])
            out = {c: np.repeat(pdf[c].iloc[:1], len(rr)) for c in layers}
            out |= {"_k": np.full(len(rr), k, "int32"), "row": rr + tr * edge, "col": cc + tc * edge}
            for i, v in enumerate(values):
                out[v] = np.where(hits[-1 if whole else i][rr, cc] > 0, sums[i, rr, cc], np.nan)
            yield pd.DataFrame({c: np.asarray(x) if c not in layers else x.to_numpy() for c, x in out.items()})

    tiles = in_tiles(cells, radius, edge).groupBy(*layers, "_k", "_tr", "_tc")
    out = tiles.applyInPandas(_frames(one_tile), schema)
    label = F.element_at(F.array(*[F.lit(k) for k in names]), F.col("_k") + 1)
    return out.select(*layers, label.alias("kernel"), "row", "col", *[F.nanvl(v, F.lit(None)).alias(v) for v in values])


def _frames(one_tile: Callable) -> Callable:
    """A grouped function that gives out one frame per kernel instead of all at once."""

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from one_tile(key, pd.concat(list(batches)))

    run.__annotations__ = {"key": tuple[Any, ...], "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return run


def apply_kernels(df: DataFrame, stack: dict[str, Offsets], values: Sequence[str] = ("value",), layers: Sequence[str] = (), mirrored: bool = False, unique: bool = False) -> DataFrame:
    """Linear convolution (or correlation when ``mirrored``) with each kernel; zero outside the grid."""
    return gather(df, stack, values, layers, mirrored, unique=unique)


# Joins of a row per cell and kernel ask for a merge: Spark sizes exploded rows and the output of Python like
# their input, and would broadcast millions of them through the driver.


def land_fraction(land: DataFrame, stack: dict[str, Offsets]) -> DataFrame:
    """(kernel, row, col, frac): share of each normalised kernel that lands on land.

    ``land`` lists each cell once, here and below.
    """
    shapes = {k: normalized(o) for k, o in stack.items()}
    hit = apply_kernels(land.withColumn("frac", F.lit(1.0)), shapes, ["frac"], mirrored=True, unique=True)
    return hit.hint("merge").join(land, ["row", "col"], "left_semi").withColumn("frac", F.greatest("frac", F.lit(1e-12)))


def redistribute(pop: DataFrame, land: DataFrame, stack: dict[str, Offsets], q: DataFrame, layers: Sequence[str] = ()) -> DataFrame:
    """sum_k Q_k * conv(pop / (f_k + 1e-6), k) on land."""
    frac = land_fraction(land, stack)
    boosted = pop.join(frac.hint("merge"), ["row", "col"]).withColumn("value", F.col("value") / (F.col("frac") + 1e-6)).drop("frac")
    arrived = gather(boosted, stack, ["value"], layers, by_kernel=True)
    return (
        arrived.hint("merge").join(q, [*layers, "row", "col", "kernel"])
        .groupBy(*layers, "row", "col").agg(F.sum(F.col("value") * F.col("Q")).alias("value"))
        .hint("merge").join(land, ["row", "col"], "left_semi")
    )


def path_integral(field: DataFrame, land: DataFrame, stack: dict[str, Offsets], steps: int, values: Sequence[str], layers: Sequence[str] = (), frame: int = 64, tile: int = TILE) -> DataFrame:
    """(layers, kernel, row, col, values): mean over ``steps`` shrinking kernels of the convolution of the
    field on land, divided by the land each kernel meets (at least 1e-6); on land cells that any step reaches.

    Missing values count 0. ``frame`` is the edge of the square in which kernels shrink. Steps are
    averaged inside a tile, so only kernels x cells leave it. ``land`` lists each cell once, and the
    field at most one row per layer and cell.
    """
    paths = {k: [shrunk(o, n, steps, frame) for n in range(1, steps + 1)] for k, o in stack.items()}
    layers, values, names = list(layers), list(values), list(stack)
    radius = _radius({f"{k}|{n}": o for k, p in paths.items() for n, o in enumerate(p)})
    edge = _edge(radius, tile)
    # one kernel at a time within the bound of a broadcast
    per = max(1, KERNEL_BYTES // (8 * steps * (2 * radius + 1) ** 2))
    types = {f.name: f.dataType for f in field.schema}
    schema = T.StructType(
        [T.StructField(c, types[c]) for c in layers] + [T.StructField("_k", T.IntegerType())]
        + [T.StructField(c, types[c]) for c in ("row", "col")] + [T.StructField(v, T.DoubleType()) for v in values]
    )
    land_tiles = in_tiles(land.select("row", "col"), radius, edge)
    cells = in_tiles(field.hint("merge").join(land, ["row", "col"], "left_semi").select(*layers, "row", "col", *[F.col(v).cast("double").alias(v) for v in values]), radius, edge)
    # land beside a layer's own cells, tile by tile
    beside = land_tiles.join(cells.select(*layers, "_tr", "_tc").distinct(), ["_tr", "_tc"]).select(*cells.columns[:len(layers)], "row", "col", *[F.lit(None).cast("double").alias(v) for v in values], "_tr", "_tc", F.lit(True).alias("_land"))
    rows = cells.withColumn("_land", F.lit(False)).unionByName(beside)
    out = None
    for start in range(0, len(names), per):
        part = names[start:start + per]
        kernels = field.sparkSession.sparkContext.broadcast([[_kernel_grid(o, radius, False) for o in paths[k] if o] for k in part])

        def one_tile(key: tuple, pdf: pd.DataFrame, kernels=kernels, start=start) -> Iterator[pd.DataFrame]:
            *_, tr, tc = key
            tr, tc, n = int(tr), int(tc), len(values)
            own = pdf["_land"].to_numpy()
            planes = _fill(pdf[~own], tr, tc, values, radius, edge)
            ground = _fill(pdf[own], tr, tc, [], radius, edge)
            inner = ground[0, radius:radius + edge, radius:radius + edge] > 0
            data = np.concatenate([planes[:n], ground])
            for k, path in enumerate(kernels.value):
                total, reach = np.zeros((n, edge, edge)), np.zeros((edge, edge))
                for grid in path:
                    moved = _products(data, grid, edge)
                    total += moved[:n] / np.maximum(moved[n], 1e-6)
                    reach += _products(planes[-1:], (grid != 0.0).astype(float), edge)[0]
                rr, cc = np.nonzero(inner & (reach > 0.5))
                frame = {c: np.repeat(pdf[c].iloc[:1], len(rr)).to_numpy() for c in layers}
                frame |= {"_k": np.full(len(rr), start + k, "int32"), "row": rr + tr * edge, "col": cc + tc * edge}
                yield pd.DataFrame(frame | {v: total[i, rr, cc] / steps for i, v in enumerate(values)})

        done = rows.groupBy(*layers, "_tr", "_tc").applyInPandas(_frames(one_tile), schema)
        out = done if out is None else out.unionByName(done)
    label = F.element_at(F.array(*[F.lit(k) for k in names]), F.col("_k") + 1)
    return out.select(*layers, label.alias("kernel"), "row", "col", *values)


def outgoing_risk(q: DataFrame, land: DataFrame, stack: dict[str, Offsets]) -> DataFrame:
    """1 - mean over kernels of corr(Q_k * land, k) / (f_k + 1e-6), on land."""
    on_land = q.hint("merge").join(land, ["row", "col"], "left_semi").withColumnRenamed("Q", "value")
    pulled = gather(on_land, stack, ["value"], mirrored=True, by_kernel=True)
    joined = land_fraction(land, stack).join(pulled.hint("merge"), ["kernel", "row", "col"], "left")
    survival = F.coalesce("value", F.lit(0.0)) / (F.col("frac") + 1e-6)
    return joined.groupBy("row", "col").agg((F.lit(1.0) - F.avg(survival)).alias("risk"))


def outgoing_risk_summed(q: DataFrame, stack: dict[str, Offsets], nrows: Column, ncols: Column, layers: Sequence[str] = ()) -> DataFrame:
    """(layers, row, col, risk): the summed kernel on 1 - mean Q; outside the grid its last row and column go on.

    ``q`` has one row per (layers, kernel, cell); cells without a row count nothing.
    """
    summed: dict[tuple[int, int], float] = {}
    for offsets in stack.values():
        for dr, dc, w in offsets:
            summed[dr, dc] = summed.get((dr, dc), 0.0) + w
    kernel = {"sum": [(dr, dc, w) for (dr, dc), w in sorted(summed.items())]}
    radius = _radius(kernel)
    death = q.groupBy(*layers, "row", "col").agg((F.lit(1.0) - F.avg("Q")).alias("risk"))
    for at, size in (("row", nrows), ("col", ncols)):
        n = size.cast("long")
        outside = F.concat(F.array(F.col(at).cast("long")), F.sequence(F.lit(-radius).cast("long"), F.lit(-1).cast("long")), F.sequence(n, n + radius - 1)) if radius else F.array(F.col(at).cast("long"))
        death = death.withColumn(at, F.explode(F.when(F.col(at) == n - 1, outside).otherwise(F.array(F.col(at).cast("long")))))
    spread = gather(death, kernel, ["risk"], layers, unique=True).drop("kernel")
    types = {f.name: f.dataType for f in q.schema}
    inside = spread.where((F.col("row") >= 0) & (F.col("row") < nrows) & (F.col("col") >= 0) & (F.col("col") < ncols))
    return inside.select(*layers, *[F.col(c).cast(types[c]).alias(c) for c in ("row", "col")], "risk")


def habitat_pull(df: DataFrame, window: int = 5, alpha: float = 5.0, eps: float = 1e-6) -> DataFrame:
    """Arriving mass weighted by local vacancy relative to the land-aware neighbourhood mean.

    Input (row, col, land, arriving, established, capacity).
    """
    cap = F.greatest("capacity", F.lit(eps))
    vacancy = df.withColumn("_v", F.col("land") / (1.0 + F.exp(-alpha * (cap - F.col("established")) / cap)))
    around = scatter(vacancy.select("row", "col", F.col("_v").alias("vsum"), F.col("land").cast("double").alias("lsum")), {"box": box(window)}, ["vsum", "lsum"])
    joined = vacancy.join(around.drop("kernel").hint("merge"), ["row", "col"])
    pull = F.col("_v") / (F.col("vsum") / (F.col("lsum") + eps) + eps)
    return joined.select("row", "col", (F.col("arriving") * pull).alias("mass"))


def blur(df: DataFrame, values: Sequence[str], sigma: float, nrows: Column, ncols: Column, layers: Sequence[str] = (), edges: str = "reflect") -> DataFrame:
    """Separable Gaussian; absent cells count 0.

    ``edges="reflect"``: the grid goes on as its mirror image (edge cell repeated), as often as the
    radius asks. Weights are symmetric, so a cell sends each weight to exactly one reflected
    index. ``"constant"``: nothing lies outside.
    """
    if edges not in ("reflect", "constant"):
        raise ValueError(f"unknown edges {edges!r}")
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    types = {f.name: f.dataType for f in df.schema}
    out = df
    for axis, size in (("row", nrows), ("col", ncols)):
        shifts = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in zip(range(-r, r + 1), weights)])
        other = "col" if axis == "row" else "row"
        sent = cluster(out.withColumn("_size", size.cast("long")), layers).withColumn("_s", F.explode(shifts))
        to = F.col(axis) + F.col("_s.d")
        if edges == "reflect":
            turn = F.pmod(to, 2 * F.col("_size"))
            sent = sent.withColumn("_to", F.least(turn, 2 * F.col("_size") - 1 - turn))
        else:
            sent = sent.withColumn("_to", to).where((F.col("_to") >= 0) & (F.col("_to") < F.col("_size")))
        out = (
            sent.select(*layers, F.col("_to").cast(types[axis]).alias(axis), other, *[(F.col("_s.w") * F.col(v)).alias(v) for v in values])
            .groupBy(*layers, "row", "col").agg(*[F.sum(v).alias(v) for v in values])
        )
    return out


def missing_aware_blur(df: DataFrame, value: str, sigma: float, nrows: Column, ncols: Column, layers: Sequence[str] = (), edges: str = "reflect", eps: float = 0.0) -> DataFrame:
    """blur(x * mask) / (blur(mask) + eps), missing where blur(mask) < eps."""
    seen = df.where(F.col(value).isNotNull()).select(*layers, "row", "col", F.col(value).alias("_x"), F.lit(1.0).alias("_m"))
    mean = F.when(F.col("_m") >= eps, F.try_divide(F.col("_x"), F.col("_m") + eps))
    return blur(seen, ["_x", "_m"], sigma, nrows, ncols, layers, edges).select(*layers, "row", "col", mean.alias(value))


def neighbour_values(df: DataFrame, value: str, layers: Sequence[str] = ()) -> DataFrame:
    """self / north / south / west / east value of each cell that has any of them."""
    sides = [("self", 0, 0), ("south", -1, 0), ("north", 1, 0), ("east", 0, -1), ("west", 0, 1)]
    sent = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for n, dr, dc in sides]))
    spread = cluster(df, layers).withColumn("_s", sent).select(
        *layers, (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col"), F.col("_s.n").alias("_n"), value
    )
    return spread.groupBy(*layers, "row", "col").agg(*[F.max(F.when(F.col("_n") == n, F.col(value))).alias(n) for n, _, _ in sides])


def volatility(zlong: DataFrame, nrows: Column, ncols: Column, n_dims: Column) -> DataFrame:
    """RMS over dims of the spatial gradient magnitude: central inside, one-sided at the edges,
    a missing difference counts 0."""
    near = neighbour_values(zlong, "zv", ["dim"]).where(F.col("self").isNotNull())
    here = F.col("self")

    def gradient(pos: str, size: Column, low: str, high: str) -> Column:
        at = F.col(pos)
        return (
            F.when(at == 0, F.col(high) - here)
            .when(at == size - 1, here - F.col(low))
            .otherwise((F.col(high) - F.col(low)) / 2.0)
        )

    gr, gc = gradient("row", nrows, "north", "south"), gradient("col", ncols, "west", "east")
    return near.groupBy("row", "col").agg(F.sqrt(F.sum(F.coalesce(gr * gr + gc * gc, F.lit(0.0))) / n_dims).alias("volatility"))


def radial_profile(table: DataFrame) -> DataFrame:
    """(kernel, ring, mean_w, rel_w): mean weight per integer distance, relative to its maximum."""
    rings = table.groupBy("kernel", F.floor(F.sqrt(F.col("dr") ** 2 + F.col("dc") ** 2)).cast("int").alias("ring")).agg(F.avg("w").alias("mean_w"))
    # a kernel has few rings, so this window is small
    peak = F.max("mean_w").over(Window.partitionBy("kernel"))
    return rings.select("kernel", "ring", "mean_w", (F.col("mean_w") / peak).alias("rel_w"))


def mass_by_distance(pop: DataFrame, stack: dict[str, Offsets]) -> DataFrame:
    """(kernel, ring, mass, cum_mass): mass sent per integer distance and its running sum."""
    rings: dict[tuple[str, int], float] = {}
    for k, offsets in stack.items():
        for dr, dc, w in offsets:
            key = (k, int(math.hypot(dr, dc)))
            rings[key] = rings.get(key, 0.0) + w
    table = F.array(*[F.struct(F.lit(k).alias("kernel"), F.lit(r).alias("ring"), F.lit(w).alias("w")) for (k, r), w in sorted(rings.items())])
    total = pop.agg(F.sum("value").alias("_total"))
    mass = total.select("_total", F.explode(table).alias("t")).select("t.kernel", "t.ring", (F.col("t.w") * F.col("_total")).alias("mass"))
    return mass.withColumn("cum_mass", F.sum("mass").over(Window.partitionBy("kernel").orderBy("ring")))


def displacement(pop: DataFrame, land: DataFrame, stack: dict[str, Offsets], cell_size: float) -> DataFrame:
    """(kernel, mean_all, mean_moved): mass-weighted displacement of what lands on land."""
    moments = {}
    for k, offsets in stack.items():
        moments[f"{k}|m"] = offsets
        moments[f"{k}|md"] = [(dr, dc, w * math.hypot(dr, dc) * cell_size) for dr, dc, w in offsets]
        moments[f"{k}|stay"] = [(dr, dc, w) for dr, dc, w in offsets if (dr, dc) == (0, 0)]
    landed = apply_kernels(pop, moments).hint("merge").join(land, ["row", "col"], "left_semi")
    parts = landed.groupBy(F.split_part("kernel", F.lit("|"), F.lit(1)).alias("kernel")).agg(
        *[F.sum(F.when(F.split_part("kernel", F.lit("|"), F.lit(2)) == p, F.col("value"))).alias(p) for p in ("m", "md", "stay")]
    )
    stay = F.coalesce("stay", F.lit(0.0))
    return parts.select("kernel", (F.col("md") / F.col("m")).alias("mean_all"), (F.col("md") / (F.col("m") - stay)).alias("mean_moved"))


def directional_expectation(s: DataFrame, grid: DataFrame, stack: dict[str, Offsets]) -> DataFrame:
    """Convolution of a survival field with each kernel where everything outside the grid is 1.

    conv(s, k) = conv(s - 1, k) + mass(k), so the outside needs no rows.
    """
    moved = apply_kernels(s.withColumn("value", F.col("value") - 1.0), stack)
    mass = F.element_at(F.create_map(*[x for k, o in stack.items() for x in (F.lit(k), F.lit(sum(w for _, _, w in o)))]), F.col("kernel"))
    return moved.hint("merge").join(grid, ["row", "col"], "left_semi").withColumn("value", F.col("value") + mass)
