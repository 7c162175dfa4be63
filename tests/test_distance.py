"""The distance transform against all pairs: dense, sparse and far sources, ties, layers, several strips."""
from __future__ import annotations

import numpy as np
import pytest

from gridloom.operators import distance, spatial


@pytest.mark.parametrize("seed, span, n", [(1, 20, 60), (2, 500, 30), (3, 100, 1), (4, 70, 900)])
def test_equals_all_pairs(spark, seed, span, n):
    rng = np.random.default_rng(seed)
    src = sorted({tuple(p) for p in rng.integers(-span, span, (n, 2)).tolist()})
    tgt = sorted({tuple(p) for p in rng.integers(-span - 40, span + 40, (150, 2)).tolist()})
    table = lambda cells: spark.createDataFrame([*cells, (None, 3), (3, None), cells[0]], "row INT, col INT")
    got = {(x["row"], x["col"]): (x["n_row"], x["n_col"], x["d"]) for x in distance.nearest_source(table(tgt), table(src)).collect()}
    assert set(got) == set(tgt)
    for t in tgt:
        d2, s = min(((s[0] - t[0]) ** 2 + (s[1] - t[1]) ** 2, s) for s in src)
        assert got[t] == (*s, pytest.approx(d2**0.5))


def test_layers_and_empty_tables(spark):
    cells = "row INT, col INT, year STRING"
    src = spark.createDataFrame([(0, 0, "a"), (9, 99, "b")], cells)
    tgt = spark.createDataFrame([(5, 50, "a"), (5, 50, "b"), (5, 50, "c")], cells)
    got = {x["year"]: (x["n_row"], x["n_col"]) for x in distance.nearest_source(tgt, src, ["year"]).collect()}
    assert got == {"a": (0, 0), "b": (9, 99)}
    none = src.where("false")
    assert distance.nearest_source(tgt, none, ["year"]).collect() == [] and distance.nearest_source(none, src, ["year"]).collect() == []
    assert distance.nearest_source(tgt.drop("year"), none.drop("year")).collect() == []


def test_agrees_with_the_pyramid(spark):
    rng = np.random.default_rng(7)
    cells = sorted({tuple(p) for p in rng.integers(0, 90, (1500, 2)).tolist()})
    src, tgt = (spark.createDataFrame(x, "row INT, col INT") for x in (cells[::9], [c for i, c in enumerate(cells) if i % 9]))
    key = ["row", "col", "n_row", "n_col"]
    assert sorted(distance.nearest_source(tgt, src).select(*key).collect()) == sorted(spatial.nearest(tgt, src, 1).select(*key).collect())
