"""Sine basis of bounded total order against plain products of sines."""
from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from gridloom.operators import similarity


def test_index_of_bounded_order():
    for n, order in ((1, 3), (3, 0), (3, 2), (4, 3)):
        got = similarity.sine_index(n, order)
        full = {tuple((d, j) for d, j in enumerate(js) if j > 1) for js in itertools.product(range(1, order + 2), repeat=n) if sum(js) - n <= order}
        assert len(got) == len(set(got)) == math.comb(n + order, order) and set(got) == full
    assert similarity.sine_index(2, 2) == [(), ((0, 2),), ((1, 2),), ((0, 3),), ((0, 2), (1, 2)), ((1, 3),)]


@pytest.mark.parametrize("n, order, unit", [(2, 3, False), (5, 2, True), (3, 0, False), (4, 4, True)])
def test_field_equals_products_of_sines(spark, n, order, unit):
    rng = np.random.default_rng(n)
    x = np.vstack([rng.uniform(-3, 3, (40, n)), np.zeros((1, n)), np.full((1, n), 3.0)])  # sines of 0 at the wall
    index = similarity.sine_index(n, order)
    weights = rng.normal(0, 1, len(index)).tolist()
    df = spark.createDataFrame([(i, v.tolist(), "kept") for i, v in enumerate(x)], "id INT, z ARRAY<DOUBLE>, note STRING")
    got = {r["id"]: r["f"] for r in similarity.sine_field(df, "z", n, order, 3.0, lambda w2: np.exp(-0.1 * w2), weights, unit=unit).collect()}
    for i, v in enumerate(x):
        want = 0.0
        for f, w in zip(index, weights):
            js = [dict(f).get(d, 1) for d in range(n)]
            wave = math.prod(math.sin(math.pi * j * (a + 3) / 6) * (1 if unit else math.sqrt(1 / 3)) for j, a in zip(js, v))
            want += w * math.exp(-0.1 * sum((math.pi * j / 6) ** 2 for j in js)) * wave
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_unusable_vectors_and_empty_tables(spark):
    rows = [(0, [0.5, 0.5]), (1, None), (2, [0.5]), (3, [0.5, None]), (4, [math.nan, 0.5]), (5, [math.inf, 0.5]), (6, [])]
    df = spark.createDataFrame(rows, "id INT, z ARRAY<DOUBLE>")
    run = lambda t: similarity.sine_field(t, "z", 2, 1, 5.0, np.ones_like, [1.0, 1.0, 1.0]).collect()
    assert [r["id"] for r in run(df) if r["f"] is not None] == [0] and len(run(df)) == 7
    assert run(df.where("false")) == []
    with pytest.raises(ValueError):
        similarity.sine_field(df, "z", 2, 1, 5.0, np.ones_like, [1.0])
