"""Kernel physics and brute-force checks of the neighbourhood operators."""
from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import focal

H, W = 23, 17


def grid_df(spark, a):
    rows = [(int(r), int(c), float(a[r, c])) for r, c in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "row INT, col INT, value DOUBLE")


def brute(a, offsets, mirrored=False):
    out = {}
    for r, c in np.ndindex(a.shape):
        for dr, dc, w in offsets:
            s = -1 if mirrored else 1
            key = (r + s * dr, c + s * dc)
            out[key] = out.get(key, 0.0) + w * a[r, c]
    return out


@pytest.fixture(scope="module")
def field():
    return np.random.default_rng(1).uniform(0, 5, (H, W))


@pytest.mark.parametrize("radius,mirrored", [(2, False), (2, True), (8, False), (8, True)])
def test_kernels_equal_brute_force(spark, field, radius, mirrored):
    stack = focal.directional(focal.isotropic(radius, 10.0, 20.0, 1.3), [0.0, 20.0, 1e9], 10.0)
    df = grid_df(spark, field)
    for out in (focal.apply_kernels(df, stack, mirrored=mirrored), focal.scatter(df, stack, ["value"], mirrored=mirrored)):
        got = {(x["kernel"], x["row"], x["col"]): x["value"] for x in out.collect()}
        for k, offsets in stack.items():
            want = brute(field, [o for o in offsets if o[2] != 0.0], mirrored)
            mine = {(r, c): v for (kk, r, c), v in got.items() if kk == k}
            assert mine.keys() == want.keys()
            assert max(abs(mine[p] - want[p]) for p in want) < 1e-9


@pytest.mark.parametrize("tile", [1, 5, 64])
def test_tile_borders_do_not_matter(spark, field, tile):
    stack = {"iso": focal.isotropic(3, 1.0, 2.0, 1.0)}
    small = focal.gather(grid_df(spark, field), stack, ["value"], tile=tile)
    got = {(x["row"], x["col"]): x["value"] for x in small.collect()}
    want = brute(field, stack["iso"])
    assert got.keys() == want.keys() and max(abs(got[p] - want[p]) for p in want) < 1e-12


def test_missing_values_large_coordinates_and_spikes_at_every_size(spark, monkeypatch):
    far = 3_000_000_000
    rows = [(far, 5, None), (far, 200, 1e9), (far, 203, 5.1e-10), (-7, 5, 2.0), (-7, 6, None)]
    df = spark.createDataFrame(rows, "row BIGINT, col BIGINT, value DOUBLE")
    for radius in (1, 20):
        stack = {"a": [(0, 0, 1.0), (0, radius, 0.5)], "b": [(0, 0, 0.25)]}
        want = {(x["kernel"], x["row"], x["col"]): x["value"] for x in focal.scatter(df, stack, ["value"]).collect()}
        for limit in (64 << 20, 8):  # one broadcast, one per kernel
            monkeypatch.setattr(focal, "KERNEL_BYTES", limit)
            got = {(x["kernel"], x["row"], x["col"]): x["value"] for x in focal.apply_kernels(df, stack).collect()}
            assert got == want
        assert want["a", far, 5] is None and want["a", far, 203] == 5.1e-10 and want["b", -7, 5] == 0.5


def test_interior_spike_keeps_its_mass(spark):
    a = np.zeros((15, 15))
    a[7, 7] = 3.0
    stack = focal.directional(focal.isotropic(4, 10.0, 15.0, 1.0), [0.0, 25.0, 1e9], 10.0)
    total = focal.apply_kernels(grid_df(spark, a).where("value > 0"), stack).agg(F.sum("value")).first()[0]
    assert total == pytest.approx(3.0, abs=1e-12)


def test_direction_weights_sum_to_one():
    for dr in range(-4, 5):
        for dc in range(-4, 5):
            assert sum(focal.direction_weight(dr, dc, b) for b in focal.BEARINGS.values()) == pytest.approx(1.0, abs=1e-12)
    assert sum(focal.direction_weight(0, 0, b, "reference") for b in focal.BEARINGS.values()) == 4.0


def test_spike_moves_in_the_named_direction(spark):
    a = np.zeros((15, 15))
    a[7, 7] = 1.0
    stack = focal.directional(focal.isotropic(4, 10.0, 15.0, 1.0), [0.0, 1e9], 10.0)
    out = focal.apply_kernels(grid_df(spark, a).where("value > 0"), stack).groupBy("kernel").agg(
        (F.sum(F.col("value") * F.col("row")) / F.sum("value")).alias("r"), (F.sum(F.col("value") * F.col("col")) / F.sum("value")).alias("c"))
    at = {x["kernel"].split("_")[1]: (x["r"], x["c"]) for x in out.collect()}
    assert at["NORTH"][0] < 7 < at["SOUTH"][0] and at["WEST"][1] < 7 < at["EAST"][1]


def test_shrunk_kernel_keeps_mass_and_direction():
    base = focal.isotropic(6, 10.0, 15.0, 1.0)
    for part in (2, 10, 20):
        assert sum(w for *_, w in focal.shrunk(base, part, 20, 64)) == pytest.approx(1.0, abs=1e-12)
    assert {(dr, dc): w for dr, dc, w in focal.shrunk(base, 20, 20, 64)} == pytest.approx({(dr, dc): w for dr, dc, w in base})
    assert focal.shrunk(base, 1, 20, 13) == []  # nothing of the frame is left
    half = focal.shrunk([(8, 0, 1.0)], 1, 2, 64)
    assert sum(dr * w for dr, _, w in half) == pytest.approx(4.0, abs=0.5)
    with pytest.raises(ValueError):
        focal.shrunk(base, 1, 2, 12)


@pytest.mark.parametrize("tile", [4, 64])
def test_path_integral_equals_dense_rule(spark, field, tile):
    stack = focal.directional(focal.isotropic(3, 1.0, 2.0, 1.0), [0.0, 1e9], 1.0)
    df = grid_df(spark, field).where("col < 15")
    land = grid_df(spark, field).where("(row + col) % 5 <> 0").select("row", "col")
    out = focal.path_integral(df, land, stack, 3, ["value"], frame=16, tile=tile)
    got = {(x["kernel"], x["row"], x["col"]): x["value"] for x in out.collect()}
    on = {(r, c) for r, c in np.ndindex(H, W) if (r + c) % 5}
    want = {}
    for k, o in stack.items():
        for n in (1, 2, 3):
            num, den = {}, {}
            for dr, dc, w in focal.shrunk(o, n, 3, 16):
                for r, c in on:
                    p = (r + dr, c + dc)
                    den[p] = den.get(p, 0.0) + w
                    if c < 15:
                        num[p] = num.get(p, 0.0) + w * field[r, c]
            for p in num.keys() & on:
                want[k, *p] = want.get((k, *p), 0.0) + num[p] / max(den[p], 1e-6) / 3
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-9)


def test_land_fraction_is_one_inland_and_smaller_at_the_coast(spark):
    land = grid_df(spark, np.ones((11, 11))).select("row", "col")
    kernel = focal.isotropic(2, 1.0, 1.0, 1.0)
    frac = {(x["row"], x["col"]): x["frac"] for x in focal.land_fraction(land, {"iso": kernel}).collect()}
    corner = sum(w for dr, dc, w in kernel if dr >= 0 and dc >= 0)
    assert frac[(5, 5)] == pytest.approx(1.0) and frac[(0, 0)] == pytest.approx(corner)


def test_path_integral_of_a_constant_is_the_constant(spark):
    df = grid_df(spark, np.full((9, 9), 4.0))
    stack = {"a": focal.isotropic(3, 1.0, 2.0, 1.0)}
    out = focal.path_integral(df, df.select("row", "col"), stack, 4, ["value"], frame=32)
    assert {round(x["value"], 9) for x in out.collect()} == {4.0}


def test_blur_of_a_constant_is_the_constant(spark):
    out = focal.blur(grid_df(spark, np.full((H, W), 2.0)), ["value"], 1.0, F.lit(H), F.lit(W)).collect()
    assert len(out) == H * W and {round(x["value"], 9) for x in out} == {2.0}


@pytest.mark.parametrize("shape", [(H, W), (3, 2), (1, 1)])
def test_blur_reflects_as_often_as_needed(spark, shape):
    a = np.random.default_rng(3).uniform(0, 1, shape)
    weights = focal.gaussian_weights(1.5)
    r = len(weights) // 2

    def gathered(x):  # along the first axis
        n = len(x)
        index = (np.arange(n)[:, None] + np.arange(-r, r + 1)[None, :]) % (2 * n)
        return np.einsum("w,nwc->nc", np.array(weights), x[np.where(index < n, index, 2 * n - 1 - index)])

    want = gathered(gathered(a).T).T
    out = focal.blur(grid_df(spark, a), ["value"], 1.5, F.lit(shape[0]), F.lit(shape[1]))
    assert {(x["row"], x["col"]): x["value"] for x in out.collect()} == pytest.approx({(r, c): want[r, c] for r, c in np.ndindex(shape)})


def test_gradient_volatility(spark):
    a = np.add.outer(np.arange(6) * 3.0, np.arange(5) * 4.0)
    long = grid_df(spark, a).withColumn("dim", F.lit(0)).withColumnRenamed("value", "zv")
    out = focal.volatility(long, F.lit(6), F.lit(5), F.lit(1)).collect()
    assert {round(x["volatility"], 9) for x in out} == {5.0}


def test_gamma_scale_gives_the_mean_distance():
    base = focal.isotropic(60, 1.0, 6.0, 1.4)
    assert sum(w * math.hypot(dr, dc) for dr, dc, w in base) == pytest.approx(6.0, rel=0.02)
