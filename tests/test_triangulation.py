"""Linear interpolation against every empty circle of all sources, with voids wider than a window, layers and planes."""
from __future__ import annotations

import numpy as np
import pytest

from gridloom.operators import triangulation


def in_circle(a, b, c, p) -> int:
    (ax, ay), (bx, by), (cx, cy) = [(int(q[0] - p[0]), int(q[1] - p[1])) for q in (a, b, c)]
    return (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx)


def cells(spark, pairs, **more):
    return spark.createDataFrame([(int(r), int(c), *more.values()) for r, c in pairs], ", ".join(["row INT", "col INT", *[f"{n} INT" for n in more]]))


def corners(rows):
    out = {}
    for x in rows:
        out.setdefault((x["row"], x["col"]), []).append(((x["n_row"], x["n_col"]), x["w"]))
    return out


@pytest.mark.parametrize("seed, span, n", [(1, 30, 60), (2, 900, 50), (3, 12, 100), (4, 300, 400)])
def test_triangles_have_empty_circles(spark, seed, span, n):
    rng = np.random.default_rng(seed)
    src = np.unique(np.r_[rng.integers(0, span, (n, 2)), rng.integers(0, 6, (20, 2)), [[0, 0], [0, span], [span, 0], [span, span]]], axis=0)
    known = {tuple(p) for p in src.tolist()}
    tgt = [p for p in {tuple(p) for p in rng.integers(0, span + 1, (60, 2)).tolist()} if p not in known] + [(-1, 0), (span + 5, span)]
    got = corners(triangulation.linear_weights(cells(spark, tgt), cells(spark, src)).collect())
    assert set(got) == set(tgt[:-2])  # all but the two outside
    for t, found in got.items():
        a, b, c = (np.array(p) for p, _ in found)
        w = np.array([x for _, x in found])
        assert w.min() >= -1e-12 and w.sum() == pytest.approx(1) and np.allclose(w @ np.array([a, b, c]), t)
        if (b[0] - a[0]) * (c[1] - a[1]) < (b[1] - a[1]) * (c[0] - a[0]):
            b, c = c, b
        assert all(in_circle(a, b, c, p) <= 0 for p in src)


def test_tiles_do_not_show(spark, monkeypatch):
    """On a grid with holes all circles hold four sources and more: other tiles and windows cut them the same way."""
    rng = np.random.default_rng(8)
    grid = {(r, c) for r in range(40) for c in range(40)}
    gaps = [p for p in sorted(grid) if rng.random() < 0.4 or 12 <= p[0] < 30 and 12 <= p[1] < 26]
    src = sorted(grid - set(gaps))
    one = corners(triangulation.linear_weights(cells(spark, gaps), cells(spark, src)).collect())
    monkeypatch.setattr(triangulation, "TILE", 9)
    monkeypatch.setattr(triangulation, "BLOCK", 5)
    monkeypatch.setattr(triangulation, "CELLS", 500)
    two = corners(triangulation.linear_weights(cells(spark, gaps), cells(spark, src)).collect())
    assert one and set(one) == set(two)
    for t, found in one.items():  # on a shared edge the third corner has no weight
        assert sorted((p, round(w, 9)) for p, w in found if w > 1e-12) == sorted((p, round(w, 9)) for p, w in two[t] if w > 1e-12)


def test_plane_radius_layers_and_missing(spark):
    rng = np.random.default_rng(4)
    land = [(r, c, y) for r in range(30) for c in range(30) for y in (1, 2, 3)]
    rows = [(r, c, y, y * r - 2.0 * c, None if rng.random() < 0.1 else 5.0) for r, c, y in land if y < 3 and rng.random() < 0.15]
    field = spark.createDataFrame([*rows, (None, 4, 1, 9.0, 9.0)], "row INT, col INT, year INT, v DOUBLE, u DOUBLE")
    table = spark.createDataFrame(land, "row INT, col INT, year INT")
    out = triangulation.fill_linear(field, table, ["v", "u"], 4.0, layers=["year"]).collect()
    assert len(out) == len(land)
    valid = {y: np.array([(r, c) for r, c, k, _, u in rows if k == y and u is not None]) for y in (1, 2)}
    filled = 0
    for x in out:
        near = x["year"] < 3 and ((valid[x["year"]] - (x["row"], x["col"])) ** 2).sum(1).min() <= 16
        if x["v"] is not None:
            assert near and x["v"] == pytest.approx(x["year"] * x["row"] - 2 * x["col"]) and x["u"] == pytest.approx(5.0)
            filled += 1
        elif near:  # outside the hull: some line through the cell has no source on one side
            d = valid[x["year"]] - (x["row"], x["col"])
            angles = np.sort(np.arctan2(d[:, 1], d[:, 0]))
            assert np.diff(np.r_[angles, angles[0] + 2 * np.pi]).max() > np.pi - 1e-9
    assert filled > 500


def test_no_triangle_without_three_corners(spark):
    none = spark.createDataFrame([], "row INT, col INT")
    line = cells(spark, [(0, 0), (1, 1), (5, 5)])
    for sources in (none, line):
        assert triangulation.linear_weights(cells(spark, [(2, 2), (3, 1)]), sources).collect() == []
    assert triangulation.linear_weights(none, line).collect() == []
