"""Hulls, neighbours and gap filling against brute force, with gaps far from any source."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import spatial


def cells(spark, pairs):
    return spark.createDataFrame([(int(r), int(c)) for r, c in pairs], "row INT, col INT")


def test_hull_contains_all_points_and_is_minimal(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(4000, 2))
    df = spark.createDataFrame(pts.tolist(), "x DOUBLE, y DOUBLE").repartition(7)
    hull = spatial.convex_hull(df, "x", "y")
    got = {tuple(p) for p in spatial.hull_vertices(pts)}
    assert {(r["x"], r["y"]) for r in hull.collect()} == got
    assert spatial.inside_hull(df, hull, "x", "y").where("NOT inside").count() == 0


def test_hull_leaves_out_collinear_points():
    square = np.array([[x, y] for x in range(5) for y in range(5)], float)
    assert sorted(map(tuple, spatial.hull_vertices(square))) == [(0, 0), (0, 4), (4, 0), (4, 4)]


def test_distance_to_hull(spark):
    df = spark.createDataFrame([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], "x DOUBLE, y DOUBLE")
    hull = spatial.convex_hull(df, "x", "y")
    probe = spark.createDataFrame([(2.0, 2.0), (7.0, 2.0), (7.0, 8.0)], "x DOUBLE, y DOUBLE")
    got = {(r["x"], r["y"]): r["distance"] for r in spatial.distance_to_hull(probe, hull, "x", "y").collect()}
    assert got == {(2.0, 2.0): 0.0, (7.0, 2.0): 3.0, (7.0, 8.0): 5.0}


@pytest.mark.parametrize("k", [1, 5, 20])
def test_nearest_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    # a dense corner, a thin strip and an empty middle: many rounds of bucket growth
    src = {(int(r), int(c)) for r, c in rng.integers(0, 12, (90, 2))} | {(90, int(c)) for c in rng.integers(0, 100, 15)}
    tgt = {(int(r), int(c)) for r, c in rng.integers(0, 100, (60, 2))} - src
    got = {}
    for x in spatial.nearest(cells(spark, tgt), cells(spark, src), k).collect():
        got.setdefault((x["row"], x["col"]), {})[x["rank"]] = (x["n_row"], x["n_col"])
    for t in tgt:
        want = sorted(src, key=lambda s: ((s[0] - t[0]) ** 2 + (s[1] - t[1]) ** 2, s))[:k]
        assert [got[t][i + 1] for i in range(len(want))] == want


def test_fewer_sources_than_k(spark):
    out = spatial.nearest(cells(spark, [(0, 0)]), cells(spark, [(50, 0), (0, 70)]), 5).collect()
    assert [(x["n_row"], x["n_col"]) for x in sorted(out, key=lambda x: x["rank"])] == [(50, 0), (0, 70)]


def test_weights_sum_to_one(spark):
    near = spatial.neighbour_weights(spatial.nearest(cells(spark, [(3, 3)]), cells(spark, [(0, 0), (3, 4), (9, 9)]), 3))
    assert near.agg(F.sum("w")).first()[0] == pytest.approx(1.0)


def test_three_stage_fill_leaves_no_land_gap(spark):
    land = cells(spark, np.ndindex(40, 10))
    field = spark.createDataFrame([(r, c, float(r)) for r in range(5) for c in range(10)], "row INT, col INT, v DOUBLE")
    ref = spark.createDataFrame([(20, c, -1.0) for c in range(10)], "row INT, col INT, v DOUBLE")
    one = spatial.fill_radius(field, land, ["v"], 4)
    got = {(r["row"], r["col"]): r["v"] for r in one.collect()}
    assert got[(2, 2)] == 2.0 and got[(8, 5)] is not None and got[(9, 5)] is None
    assert got[(8, 5)] == pytest.approx(4.0)
    two = spatial.fill_static(one, ref, ["v"])
    three = {(r["row"], r["col"]): r["v"] for r in spatial.fill_nearest(two, ["v"]).collect()}
    assert len(three) == 400 and None not in three.values()
    assert three[(20, 3)] == -1.0 and three[(39, 3)] == -1.0


def test_half_land_half_ocean_keeps_candidates_few(spark, monkeypatch):
    kept = []
    plain = spatial._with_bound

    def counted(*args):
        out = plain(*args)
        kept.append(out.agg(F.sum(F.size(F.filter("_c", lambda b: b["lo"] <= F.col("_hi"))))).first()[0])
        return out

    monkeypatch.setattr(spatial, "_with_bound", counted)
    n, k = 32, 3
    land = cells(spark, [(r, c) for r in range(n) for c in range(n)])
    sea = cells(spark, [(r, c) for r in range(n) for c in range(n, 2 * n)])
    out = {(x["row"], x["col"], x["rank"]): (x["n_row"], x["n_col"]) for x in spatial.nearest(sea, land, k).collect()}
    assert len(out) == k * n * n and all(out[r, c, 1] == (r, n - 1) for r in range(n) for c in range(n, 2 * n))
    assert max(kept) <= 8 * k * n * n  # all pairs would be 1024 * 1024


def test_layers_do_not_mix_and_empty_layers_stay_missing(spark):
    rows = [(0, 0, 1, 1.0), (0, 9, 1, None), (0, 0, 2, None), (0, 9, 2, 7.0), (5, 5, 3, None), (5, 6, 3, None)]
    field = spark.createDataFrame(rows, "row INT, col INT, year INT, v DOUBLE")
    got = {(x["row"], x["col"], x["year"]): x["v"] for x in spatial.fill_nearest(field, ["v"], layers=["year"]).collect()}
    assert got == {(0, 0, 1): 1.0, (0, 9, 1): 1.0, (0, 0, 2): 7.0, (0, 9, 2): 7.0, (5, 5, 3): None, (5, 6, 3): None}
    nothing = spatial.fill_nearest(field.where("year = 3").drop("year"), ["v"]).collect()
    assert len(nothing) == 2 and all(x["v"] is None for x in nothing)
