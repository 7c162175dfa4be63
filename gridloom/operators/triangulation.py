"""Linear interpolation over the Delaunay triangulation of all source cells, without building it in one place.

A target needs one triangle: the one with an empty circumdisc that contains it. A task holds the targets of a tile and the
sources of the tile's window, and descends for each target from any triangle around it to the one that no source in the window
lies in the disc of. If the disc lies inside the window, no source elsewhere can be in it either, and the triangle is
that of the whole table. Other targets go on to a window four times as wide. Their discs are known to be at least half the last
halo in radius, so of every square block with that edge only the first and last source of each row and column can
matter: a window's sources grow with its edge, not with its area.

Sources on one empty circle (the rule on grids) form a polygon, cut into triangles from its smallest (row, col): the
result does not depend on tiles. Targets outside the hull of the sources have no triangle. Determinants of cell numbers are exact
within windows up to ``EXACT`` cells wide; beyond, near zeros are settled in whole numbers.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import durable

TILE, BLOCK = 64, 16
#: Cells of a (targets x sources) matrix held at once.
CELLS = 1 << 21
#: 12 d^4 stays below 2^53.
EXACT = 4096


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _first_triangle(t: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Any triangle of sources around each target, counter-clockwise; -1 where there is none."""
    d = s[None] - t[:, None]
    near = np.argmin((d * d).sum(-1), 1)
    rows = np.arange(len(t))
    base = d[rows, near][:, None]
    side, along = _cross(base, d), (base * d).sum(-1)
    angle = np.arctan2(side, along)
    left = (side > 0) | ((side == 0) & (along < 0))
    a = np.argmax(np.where(left, np.where(side == 0, np.pi, angle), -9.0), 1)
    b = np.argmin(np.where(side < 0, angle, 9.0), 1)
    has_right = (side < 0).any(1)
    # on the line from the nearest source to an opposite one, a third corner on either side will do
    opposite = left.any(1) & (side[rows, a] == 0)
    other = np.argmax(np.where(side > 0, angle, -9.0), 1)
    lone = opposite & ~has_right & (side > 0).any(1)
    first, second = np.where(lone, other, a), np.where(lone, a, b)
    found = (left.any(1) & has_right | lone) & (_cross(d[rows, first], d[rows, second]) >= 0)
    return np.where(found[:, None], np.c_[near, first, second], -1)


def _discs(v: np.ndarray, t: np.ndarray, s: np.ndarray) -> np.ndarray:
    """In-circle determinant of each source for each triangle (targets x sources): positive inside. Coordinates are relative to ``t``."""
    x, y = v[..., 0], v[..., 1]
    q = x * x + y * y
    # expanded along the lifted point (x, y, x^2 + y^2, 1)
    def minor(a, b):
        return a[:, 0] * (b[:, 1] - b[:, 2]) + a[:, 1] * (b[:, 2] - b[:, 0]) + a[:, 2] * (b[:, 0] - b[:, 1])

    one = (x[:, 0] * (y[:, 1] * q[:, 2] - y[:, 2] * q[:, 1]) - y[:, 0] * (x[:, 1] * q[:, 2] - x[:, 2] * q[:, 1]) + q[:, 0] * (x[:, 1] * y[:, 2] - x[:, 2] * y[:, 1]))
    px, py = s[None, :, 0] - t[:, None, 0], s[None, :, 1] - t[:, None, 1]
    return one[:, None] + px * minor(q, y)[:, None] + py * minor(x, q)[:, None] - (px * px + py * py) * minor(x, y)[:, None]


def _settled(det: np.ndarray, v: np.ndarray, t: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Signs near zero recomputed in whole numbers where doubles may round."""
    size = float(np.abs(v).max(initial=1) + np.abs(s[None] - t[:, None]).max(initial=1))
    if size <= EXACT:
        return det
    for i, j in np.argwhere(np.abs(det) < 1e-13 * size**4):
        p = [int(c) for c in s[j] - t[i]]
        (ax, ay), (bx, by), (cx, cy) = ([int(c) - p[k] for k, c in enumerate(corner)] for corner in v[i])
        det[i, j] = float((ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx))
    return det


def _weights(v: np.ndarray) -> np.ndarray:
    """Barycentric weights of the origin in each triangle."""
    w = np.c_[_cross(v[:, 1], v[:, 2]), _cross(v[:, 2], v[:, 0]), _cross(v[:, 0], v[:, 1])]
    return w / w.sum(1, keepdims=True)


def _fan(det: np.ndarray, corners: np.ndarray, t: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The triangle of the polygon of all sources on one circle, cut from its smallest corner, that holds the target."""
    on = np.union1d(np.flatnonzero(det == 0), corners)
    if len(on) == 3:
        return corners
    on = on[np.lexsort((s[on, 1], s[on, 0]))]
    root, rest = on[0], on[1:]
    d = s[rest] - s[root]
    rest = rest[np.argsort(np.arctan2(d[:, 1], d[:, 0]), kind="stable")]
    turn = _cross(s[rest] - s[root], np.broadcast_to(t - s[root], (len(rest), 2)))
    k = min(max(int((turn >= 0).sum()) - 1, 0), len(rest) - 2)
    return np.array([root, rest[k], rest[k + 1]])


def triangles(t: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each target: its Delaunay triangle among ``s`` (indices, -1 outside their hull), weights, and circumdisc (row, col, radius)."""
    found, weights, discs = np.full((len(t), 3), -1), np.zeros((len(t), 3)), np.tile([0.0, 0.0, np.inf], (len(t), 1))
    if len(s) < 3:
        return found, weights, discs
    t, s = t.astype(float), s.astype(float)
    step = max(1, CELLS // len(s))
    for lo in range(0, len(t), step):
        part = t[lo:lo + step]
        corner = _first_triangle(part, s)
        live = np.flatnonzero(corner[:, 0] >= 0)
        todo = live
        while len(todo):
            v = s[corner[todo]] - part[todo][:, None]
            det = _settled(_discs(v, part[todo], s), v, part[todo], s)
            det[np.arange(len(todo))[:, None], corner[todo]] = 0
            worst = np.argmax(det, 1)
            bad = det[np.arange(len(todo)), worst] > 0
            for i in np.flatnonzero(~bad).tolist():
                corner[todo[i]] = _fan(det[i], corner[todo[i]], part[todo[i]], s)
            todo, v, worst = todo[bad], v[bad], worst[bad]
            p = s[worst] - part[todo]
            own = np.c_[_cross(v[:, 1], v[:, 2]), _cross(v[:, 2], v[:, 0]), _cross(v[:, 0], v[:, 1])]
            shift = v - p[:, None]
            its = np.c_[_cross(shift[:, 1], shift[:, 2]), _cross(shift[:, 2], shift[:, 0]), _cross(shift[:, 0], shift[:, 1])]
            # the corner whose weight the new source uses up first leaves
            leaves = np.argmin(np.where(its > 0, own / np.where(its > 0, its, 1), np.inf), 1)
            corner[todo, leaves] = worst
            flip = _cross(s[corner[todo, 1]] - s[corner[todo, 0]], s[corner[todo, 2]] - s[corner[todo, 0]]) < 0
            corner[todo[flip]] = corner[todo[flip]][:, [0, 2, 1]]
        v = s[corner[live]] - part[live][:, None]
        b, c = v[:, 1] - v[:, 0], v[:, 2] - v[:, 0]
        area, bb, cc = 2 * _cross(b, c), (b * b).sum(1), (c * c).sum(1)
        centre = np.c_[c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb] / area[:, None]
        found[lo + live], weights[lo + live] = corner[live], _weights(v)
        discs[lo + live] = np.c_[centre + v[:, 0] + part[live], np.hypot(*centre.T)]
    return found, weights, discs


def _inside(discs: np.ndarray, window: tuple, box: tuple) -> np.ndarray:
    """No cell of the disc lies outside the window, or where sources could be."""
    r0, r1, c0, c1 = window
    out = np.ones(len(discs), bool)
    for low, high, at, first, last in ((r0, r1, 0, box[0], box[1]), (c0, c1, 1, box[2], box[3])):
        out &= (low <= first) | (discs[:, at] - discs[:, 2] > low - 1 + 1e-6)
        out &= (high >= last) | (discs[:, at] + discs[:, 2] < high + 1 - 1e-6)
    return out & np.isfinite(discs[:, 2]) | ((r0 <= box[0]) & (r1 >= box[1]) & (c0 <= box[2]) & (c1 >= box[3]))


def _tile(pdf: pd.DataFrame, window: tuple, box: tuple, radius: float | None, halos: Sequence[int]) -> list[np.ndarray]:
    """(target, state, three sources, three weights) of one tile; state 1 found, 0 outside the hull, -1 not known yet."""
    cells = pdf[["row", "col"]].to_numpy(np.int64)
    asks = pdf["_asks"].to_numpy(bool)
    t, s = cells[asks], np.unique(cells[~asks], axis=0)
    out = []
    for _, at in pd.Series(np.arange(len(t))).groupby([t[:, 0] // BLOCK, t[:, 1] // BLOCK]):
        at = at.to_numpy()
        if radius is not None and len(s):
            reach = s[(np.abs(s - t[at].mean(0)) <= radius + BLOCK).all(1)]
            step = max(1, CELLS // max(len(reach), 1))
            at = np.concatenate([a[(((t[a][:, None] - reach[None]) ** 2).sum(-1) <= radius * radius).any(1)] for a in np.split(at, range(step, len(at), step))])
        for halo in [*halos, None]:
            if not len(at):
                break
            low, high = t[at].min(0), t[at].max(0)
            near = window if halo is None else (low[0] - halo, high[0] + halo, low[1] - halo, high[1] + halo)
            near = (max(near[0], window[0]), min(near[1], window[1]), max(near[2], window[2]), min(near[3], window[3]))
            own = s[(s[:, 0] >= near[0]) & (s[:, 0] <= near[1]) & (s[:, 1] >= near[2]) & (s[:, 1] <= near[3])]
            corner, weight, disc = triangles(t[at], own)
            done = _inside(disc, near, box)
            if halo is None:
                state = np.where(~done, -1, np.where(corner[:, 0] >= 0, 1, 0))
                take = np.ones(len(at), bool)
            else:
                take, state = done, np.where(corner[:, 0] >= 0, 1, 0)
            if take.any():
                points = own[np.maximum(corner, 0)].reshape(len(at), 6) if len(own) else np.zeros((len(at), 6), np.int64)
                out.append(np.c_[t[at], state, points, weight][take])
            at = at[~take]
    return out


_FOUND = "row long, col long, state int, " + ", ".join(f"{c}{k} long" for k in range(3) for c in "rc") + ", w0 double, w1 double, w2 double"
_NAMES = ["row", "col", "state", "r0", "c0", "r1", "c1", "r2", "c2", "w0", "w1", "w2"]


def _thinned(sources: DataFrame, layers: Sequence[str], edge: int) -> DataFrame:
    """The first and last source of each row and each column of every block."""
    block = [F.floor(F.col(c) / edge).alias(f"_b{c}") for c in ("row", "col")]
    rows = sources.groupBy(*layers, "row", block[1]).agg(F.min("col").alias("a"), F.max("col").alias("b")).select(*layers, "row", F.explode(F.array("a", "b")).alias("col"))
    cols = sources.groupBy(*layers, "col", block[0]).agg(F.min("row").alias("a"), F.max("row").alias("b")).select(*layers, F.explode(F.array("a", "b")).alias("row"), "col")
    return rows.unionByName(cols).distinct()


def _solver(layers: Sequence[str], tile: int, halo: int, box: tuple, radius: float | None, halos: Sequence[int]):
    """The function of one tile's key and rows."""

    def solve(key, pdf):
        r, c = int(key[-2]) * tile, int(key[-1]) * tile
        found = _tile(pdf, (r - halo, r + tile - 1 + halo, c - halo, c + tile - 1 + halo), box, radius, halos)
        out = pd.DataFrame(np.vstack(found) if found else np.zeros((0, len(_NAMES))), columns=_NAMES).astype({c: "int64" for c in _NAMES[:9]})
        for i, name in enumerate(layers):
            out.insert(i, name, pd.Series([key[i]] * len(out), dtype=object))
        return out

    return solve


def linear_weights(targets: DataFrame, sources: DataFrame, radius: float | None = None, layers: Sequence[str] = ()) -> DataFrame:
    """(layers, row, col, n_row, n_col, w): three weighted source cells for each target cell inside the hull of its layer's
    sources, and within ``radius`` of one of them if given. Targets must not be sources. Cells without coordinates are
    left out, repeated cells count once; an empty table on either side, or sources on one line, give no rows."""
    layers = list(layers)
    at = [*layers, *[F.col(c).cast("long").alias(c) for c in ("row", "col")]]
    src = durable(sources.where("row IS NOT NULL AND col IS NOT NULL").select(*at).distinct())
    left = targets.where("row IS NOT NULL AND col IS NOT NULL").select(*at).distinct()
    box = src.agg(*[f(c) for c in ("row", "col") for f in (F.min, F.max)]).first()
    nothing = "row long, col long, n_row long, n_col long, w double"
    parts: list[DataFrame] = []
    tasks = 2 * src.sparkSession.sparkContext.defaultParallelism
    halo, tile, thin = max(32, int(np.ceil(radius or 0))), TILE, src
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in layers)
    while box[0] is not None:
        def deal(df: DataFrame, asks: bool, reach: int, tile: int = tile) -> DataFrame:
            span = [F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))).alias(f"_t{c}") for c in ("row", "col")]
            return df.select(*layers, "row", "col", span[0]).select("*", span[1]).withColumn("_asks", F.lit(asks))

        key = [*layers, "_trow", "_tcol"]
        asked = deal(left, True, 0)
        around = deal(thin, False, halo).join(asked.select(*key).distinct(), key, "left_semi")
        first = not parts
        solve = _solver(layers, tile, halo, tuple(box), radius if first else None, (4, 16) if first else ())
        dealt = asked.unionByName(around)
        if not first:  # a wide window's rows are few and its work is long: tasks by number, not by bytes
            dealt = dealt.repartition(tasks, *key)
        done = durable(dealt.groupBy(*key).applyInPandas(solve, f"{kinds}{', ' if layers else ''}{_FOUND}"))
        parts.append(done.where("state = 1"))
        left = done.where("state = -1").select(*layers, "row", "col")
        if left.isEmpty():
            break
        edge = max(1, halo // 2)
        halo *= 4
        tile, thin = max(TILE, halo), _thinned(src, layers, edge)
    if not parts:
        return targets.sparkSession.createDataFrame([], f"{kinds}{', ' if layers else ''}{nothing}")
    corners = [F.struct(F.col(f"r{k}").alias("n_row"), F.col(f"c{k}").alias("n_col"), F.col(f"w{k}").alias("w")) for k in range(3)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(*layers, "row", "col", F.inline(F.array(*corners)))


def fill_linear(field: DataFrame, land: DataFrame, values: Sequence[str], radius: float, layers: Sequence[str] = ()) -> DataFrame:
    """Missing land cells within ``radius`` of a valid cell take the linear interpolation of the valid cells (of their
    layer); cells outside the valid cells' hull stay missing. One row per (layer and) land cell; a cell is valid if it has all values."""
    at = [*layers, "row", "col"]
    whole = F.lit(True)
    for v in values:
        whole = whole & F.col(v).isNotNull()
    valid = durable(field.where(whole).select(*at, *values))
    gaps = land.select(*at).join(valid, at, "left_anti")
    near = linear_weights(gaps, valid, radius, layers)
    corner = valid.select(*layers, F.col("row").alias("n_row"), F.col("col").alias("n_col"), *[F.col(v).alias(f"_v_{v}") for v in values])
    filled = near.join(corner, [*layers, "n_row", "n_col"]).groupBy(*at).agg(*[F.sum(F.col("w") * F.col(f"_v_{v}")).alias(f"_f_{v}") for v in values])
    joined = land.select(*at).join(valid, at, "left").join(filled, at, "left")
    return joined.select(*at, *[F.coalesce(v, f"_f_{v}").alias(v) for v in values])
