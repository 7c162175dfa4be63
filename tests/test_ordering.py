"""Order statistics under skew: one value holds a third of the rows."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import ordering


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(5)
    v = np.concatenate([np.full(1000, 7.0), rng.normal(5, 4, 2000).round(2)])
    g = np.where(rng.uniform(size=3000) < 0.6, "hot", rng.choice(["a", "b", "c"], 3000))
    rng.shuffle(v)
    return pd.DataFrame({"id": np.arange(3000), "g": g, "v": v})


@pytest.mark.parametrize("ranges", [4, 300, 1100])
def test_row_numbers(spark, skewed, ranges):
    out = ordering.row_numbers(spark.createDataFrame(skewed), ["v", "id"], "rn", ranges=ranges).toPandas().set_index("id")["rn"]
    want = skewed.sort_values(["v", "id"]).reset_index(drop=True)
    assert [out[i] for i in want["id"]] == list(range(1, 3001))


def test_average_ranks_global_and_grouped(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = ordering.average_ranks(df, "v", "r").toPandas().set_index("id")["r"]
    assert np.array_equal(got.sort_index(), skewed.set_index("id")["v"].rank().sort_index())
    grouped = ordering.average_ranks(df, "v", "r", group=["g"]).toPandas().set_index("id")["r"]
    assert np.array_equal(grouped.sort_index(), skewed.set_index("id").groupby("g")["v"].rank().sort_index())


def test_missing_values_have_no_rank(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 1.0), (4, 3.0)], "id INT, v DOUBLE")
    got = {r["id"]: r["r"] for r in ordering.average_ranks(df, "v", "r").collect()}
    assert got == {1: 2.5, 2: None, 3: 1.0, 4: 2.5}


def test_exact_quantiles(spark, skewed):
    probs = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    df = spark.createDataFrame(skewed)
    one = ordering.exact_quantiles(df, "v", probs, names).first()
    assert [one[n] for n in names] == pytest.approx(list(np.quantile(skewed["v"], probs)), abs=1e-12)
    for row in ordering.exact_quantiles(df, "v", probs, names, group=["g"]).collect():
        want = np.quantile(skewed[skewed["g"] == row["g"]]["v"], probs)
        assert [row[n] for n in names] == pytest.approx(list(want), abs=1e-12)


def test_running_minimum(spark, skewed):
    df = spark.createDataFrame(skewed)
    out = ordering.running_min_before(df, ["id"], "v", "m", ranges=5).toPandas().sort_values("id")
    want = skewed.sort_values("id")["v"].cummin().shift(1)
    assert np.array_equal(out["m"].to_numpy(), want.to_numpy(), equal_nan=True)


def test_no_single_task_window(spark, skewed):
    df = spark.createDataFrame(skewed)
    plan = ordering.average_ranks(df, "v", "r")._jdf.queryExecution().executedPlan().toString()
    assert "_rng" in plan
    assert df.select("v").distinct().count() > 100
    assert F is not None
