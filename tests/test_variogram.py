"""All-pairs variogram against a loop over pairs: several tiles, layers, repeated rows, missing values, one distance."""
from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from gridloom.operators import variogram


def by_pairs(rows, radius):
    """{(layer, dr, dc): [n, dot, squares]} over all pairs of rows of different cells."""
    out = defaultdict(lambda: [0, 0.0, 0.0])
    for i, (y, r, c, z) in enumerate(rows):
        for y2, r2, c2, z2 in rows[i + 1:]:
            dr, dc = r2 - r, c2 - c
            if y == y2 and (dr, dc) != (0, 0) and dr * dr + dc * dc <= radius * radius:
                dr, dc = (dr, dc) if (dr, dc) > (0, 0) else (-dr, -dc)
                s = out[y, dr, dc]
                s[0] += 1
                s[1] += float(np.dot(z, z2))
                s[2] += float(np.dot(z, z) + np.dot(z2, z2))
    return out


def table(spark, rows):
    return spark.createDataFrame([(y, r, c, [float(x) for x in z]) for y, r, c, z in rows], "year STRING, row INT, col INT, z ARRAY<DOUBLE>")


@pytest.mark.parametrize("radius, tile, dims, span", [(3, 4, 3, 20), (6.5, 64, 11, 40), (1, 2, 1, 9), (30, 8, 2, 40)])
def test_equals_all_pairs(spark, radius, tile, dims, span):
    rng = np.random.default_rng(int(radius * 10))
    rows = [(str(rng.integers(2)), *rng.integers(-span, span, 2).tolist(), rng.normal(0, 2, dims)) for _ in range(350)]
    rows += rows[:20]  # the same rows again
    got = {(x["year"], x["dr"], x["dc"]): x for x in variogram.lag_sums(table(spark, rows), "z", dims, radius, ["year"], tile).collect()}
    want = by_pairs(rows, radius)
    assert set(got) == set(want)
    for k, (n, dot, squares) in want.items():
        assert got[k]["n"] == n and got[k]["dot"] == pytest.approx(dot, abs=1e-9) and got[k]["squares"] == pytest.approx(squares, rel=1e-9)


def test_bins_and_trend(spark):
    rng = np.random.default_rng(5)
    rows = [("a", r, c, rng.normal(0, 1, 4)) for r in range(12) for c in range(9)]
    pairs = [(math.dist(a[1:3], b[1:3]), 1 - float(np.dot(a[3], b[3])), float(((a[3] - b[3]) ** 2).sum()) / 2) for i, a in enumerate(rows) for b in rows[i + 1:]]
    pairs = [p for p in pairs if p[0] <= 7]
    got = variogram.turnover(table(spark, rows).drop("year"), "z", 4, 7, 2.0, tile=5).collect()
    assert sorted(x["bin"] for x in got) == [0, 1, 2, 3]
    slope = np.polyfit([p[0] for p in pairs], [p[1] for p in pairs], 1)[0]
    for x in got:
        own = [p for p in pairs if int(p[0] // 2) == x["bin"]]
        assert x["n"] == len(own) and x["slope"] == pytest.approx(slope)
        assert x["turnover"] == pytest.approx(np.mean([p[1] for p in own])) and x["semivariance"] == pytest.approx(np.mean([p[2] for p in own]))


def test_left_out_rows_layers_and_empty_tables(spark):
    good = [("a", 0, 0, [1.0, 0.0]), ("a", 0, 1, [1.0, 1.0]), ("b", 0, 0, [5.0, 5.0]), (None, 3, 3, [1.0, 2.0]), (None, 4, 3, [2.0, 1.0])]
    bad = [("a", None, 1, [1.0, 1.0]), ("a", 1, None, [1.0, 1.0]), ("a", 1, 1, None), ("a", 1, 1, [1.0]), ("a", 1, 1, [None, 1.0]), ("a", 1, 1, [math.nan, 1.0]), ("a", 1, 1, [math.inf, 1.0])]
    df = spark.createDataFrame(good + bad, "year STRING, row INT, col INT, z ARRAY<DOUBLE>")
    got = {x["year"]: tuple(x)[1:] for x in variogram.turnover(df, "z", 2, 2, 1.0, ["year"]).collect()}
    assert got == {"a": (1, 1, pytest.approx(0.0), pytest.approx(0.5), None), None: (1, 1, pytest.approx(-3.0), pytest.approx(1.0), None)}
    assert variogram.turnover(df.where("false"), "z", 2, 2, 1.0, ["year"]).collect() == []
    assert variogram.turnover(df.where("false"), "z", 2, 2, 1.0).collect() == []
