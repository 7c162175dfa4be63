"""Series, embeddings, statistics and traits: invariants and edge cases."""
from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import links, vectors
from gridloom.operators import clean, grid, sampling, similarity, stats, temporal, traits
from gridloom.sources import scans


def vec_df(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id INT, z ARRAY<DOUBLE>")


# -- time series ---------------------------------------------------------------------


def test_ema_of_a_constant_and_of_gaps(spark):
    df = spark.createDataFrame([(1, t, 5.0) for t in range(8)] + [(2, 0, None), (2, 1, 4.0), (2, 2, None), (2, 3, 8.0)], "k INT, t INT, x DOUBLE")
    got = {(r["k"], r["t"]): r["state"] for r in temporal.ema(df, ["k"], "t", "x", 0.25).collect()}
    assert {got[(1, t)] for t in range(8)} == {5.0}
    assert (got[(2, 0)], got[(2, 1)], got[(2, 2)], got[(2, 3)]) == (None, 4.0, 4.0, 5.0)
    dead = {(r["k"], r["t"]): r["state"] for r in temporal.ema(df, ["k"], "t", "x", 0.25, "reference").collect()}
    assert [dead[(2, t)] for t in range(4)] == [None] * 4


def test_interpolation_edges(spark):
    df = spark.createDataFrame([("two", 1, 10.0), ("two", 3, 14.0), ("one", 2, 7.0), ("none", 2, None)], "k STRING, t INT, x DOUBLE")
    line = {(r["k"], r["t"]): r["x"] for r in temporal.linear_interpolate(df, ["k"], "t", "x", 0, 5).collect()}
    assert [line[("two", t)] for t in range(6)] == [8.0, 10.0, 12.0, 14.0, 16.0, 18.0]
    assert {line[("one", t)] for t in range(6)} == {7.0} and {line[("none", t)] for t in range(6)} == {None}
    clamp = {(r["k"], r["t"]): r["x"] for r in temporal.bracket_interpolate(df.where("x IS NOT NULL"), ["k"], "t", "x", 0, 5).collect()}
    assert [clamp[("two", t)] for t in range(6)] == [10.0, 10.0, 12.0, 14.0, 14.0, 14.0]


def test_circular_smoothing_keeps_the_yearly_sum_and_wraps(spark):
    df = spark.createDataFrame([(1, 0, 10.0)], "k INT, week INT, x DOUBLE")
    out = {r["week"]: r["x"] for r in temporal.circular_smooth(df, ["k"], "week", "x", 1.5).collect()}
    assert sum(out.values()) == pytest.approx(10.0) and out[51] == pytest.approx(out[1])


def test_hellinger_of_an_empty_row(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 1.0), (2, 3.0)], "cell INT, x DOUBLE")
    got = sorted((r["cell"], r["x"]) for r in temporal.hellinger(df, "cell", "x").collect())
    assert got == [(1, 0.0), (1, 0.0), (2, 0.5), (2, math.sqrt(0.75))]


def test_bio_year_needs_every_layer(spark):
    rows = [(y, m, v) for y in (1999, 2000) for m in range(1, 13) for v in "ab" if not (y == 2000 and m == 3 and v == "b")]
    df = spark.createDataFrame(rows, "year INT, month INT, var STRING")
    assert {r[0] for r in temporal.complete_bio_years(df, 24, "var").select("bio_year").distinct().collect()} == set()
    full = df.unionByName(spark.createDataFrame([(2000, 3, "b")], df.schema))
    assert {r[0] for r in temporal.complete_bio_years(full, 24, "var").select("bio_year").distinct().collect()} == {2000}


# -- embeddings ------------------------------------------------------------------------


@pytest.mark.parametrize("kind,params", [("ruzicka", {}), ("rq", {"lengthscale": 1.0, "alpha": 1.5}), ("rbf", {"lengthscale": 1.0}), ("ruzicka_by_species", {"n_species": 3})])
def test_full_rank_nystrom_reproduces_the_kernel(spark, kind, params):
    x = np.random.default_rng(2).gamma(1.0, 1.0, (40, 12))
    z = similarity.nystrom(vec_df(spark, x), "id", "z", 40, 40, kind, params).toPandas().sort_values("id")
    zz = np.stack(z["z"])
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    low, high = np.minimum(x[:, None], x[None]), np.maximum(x[:, None], x[None])
    by_species = [low[..., s:s + 4].sum(-1) / high[..., s:s + 4].sum(-1) for s in (0, 4, 8)]
    want = {"ruzicka": low.sum(-1) / high.sum(-1), "rq": (1 + d2 / 3) ** -1.5, "rbf": np.exp(-d2 / 2), "ruzicka_by_species": sum(by_species) / 3}[kind]
    assert np.abs(zz @ zz.T - want).max() < 1e-6


def test_smaller_embedding_is_a_leading_slice(spark):
    df = vec_df(spark, np.random.default_rng(4).gamma(1.0, 1.0, (30, 6)))
    big = np.stack(similarity.nystrom(df, "id", "z", 8, 20, "ruzicka").toPandas().sort_values("id")["z"])
    small = np.stack(similarity.nystrom(df, "id", "z", 3, 20, "ruzicka").toPandas().sort_values("id")["z"])
    assert np.abs(big[:, :3] - small).max() < 1e-9


@pytest.mark.parametrize("part", [1, 200, 1 << 20])
@pytest.mark.parametrize("kind", ["ruzicka", "ruzicka_by_species"])
def test_ruzicka_to_landmarks_holds_every_pair(spark, monkeypatch, kind, part):
    monkeypatch.setattr(similarity, "PART_BYTES", part)
    rng = np.random.default_rng(6)
    # cells 0-3 and 4-7 share no week, so half of all pairs have similarity 0
    rows = [(c, s, w + 6 * (c > 3), float(rng.integers(1, 9))) for c in range(8) for s in "ab" for w in range(6) if rng.uniform() < 0.6]
    vec, width, n = similarity.sparse_vectors(spark.createDataFrame(rows, "cell INT, species STRING, week INT, x DOUBLE"), "cell", 12)
    got = similarity.against_landmarks(vec, vec, "cell", "vec", kind, {"n_species": n}, width).collect()
    k = {(r["cell"], r["lm"]): r["k"] for r in got}
    assert len(got) == len(k) == 64
    x = np.zeros((8, 2, 12))
    for c, s, w, v in rows:
        x[c, "ab".index(s), w] = v
    x = x if kind == "ruzicka_by_species" else x.reshape(8, 1, 24)
    for (i, j), v in k.items():
        low, high = np.minimum(x[i], x[j]).sum(1), np.maximum(x[i], x[j]).sum(1)
        assert v == pytest.approx(np.divide(low, high, out=np.zeros_like(low), where=high > 0).mean())
    assert all(k[i, j] == 0 for i in range(4) for j in range(4, 8))


def test_leading_pairs_of_many_landmarks(spark):
    # more landmarks than the first block spans, so the basis has to grow
    x = np.random.default_rng(3).gamma(1.0, 1.0, (150, 5))
    z = np.stack(similarity.nystrom(vec_df(spark, x), "id", "z", 4, 150, "rbf", {"lengthscale": 1.0}).toPandas().sort_values("id")["z"])
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2)
    values, basis = np.linalg.eigh(k)
    best = (basis[:, -4:] * values[-4:]) @ basis[:, -4:].T
    assert np.abs(z @ z.T - best).max() < 1e-8


def test_nystrom_of_few_and_no_rows(spark):
    df = vec_df(spark, np.ones((3, 2)))
    assert similarity.nystrom(df, "id", "z", 8, 20, "linear").count() == 3
    assert similarity.nystrom(df.where("false"), "id", "z", 8, 20, "linear").count() == 0


def test_more_pairs_than_rows(spark):
    df = spark.range(7)
    got = sampling.sample_pairs(df, "id", 50, 3).collect()
    assert sorted(r["pair"] for r in got) == list(range(1, 51))
    # every round of seven uses each row once on each side
    for side in ("id_a", "id_b"):
        assert sorted(r[side] for r in got if r["pair"] <= 7) == list(range(7))
    assert {r["id_a"] for r in got if r["pair"] > 49} < set(range(7))
    assert len({tuple(r["id_a"] for r in sorted(got) if (r["pair"] - 1) // 7 == c) for c in range(7)}) > 1
    assert sampling.sample_pairs(df.where("false"), "id", 5, 3).count() == 0


def test_sparse_and_dense_vectors_agree(spark):
    x = np.random.default_rng(8).gamma(1.0, 1.0, (20, 8)) * (np.random.default_rng(9).uniform(size=(20, 8)) < 0.5)
    rows = [(i, "s", w, float(v)) for i, r in enumerate(x) for w, v in enumerate(r) if v > 0]
    sparse, width, _ = similarity.sparse_vectors(spark.createDataFrame(rows, "id INT, species STRING, week INT, x DOUBLE"), "id", 8)
    keep = sorted({r[0] for r in rows})
    a = np.stack(similarity.nystrom(sparse, "id", "vec", 4, 12, "ruzicka", width=width).toPandas().sort_values("id")["z"])
    b = np.stack(similarity.nystrom(vec_df(spark, x).where(F.col("id").isin(keep)), "id", "z", 4, 12, "ruzicka").toPandas().sort_values("id")["z"])
    assert np.abs(a - b).max() < 1e-9


def test_principal_components(spark):
    x = np.random.default_rng(10).normal(size=(200, 5)) @ np.random.default_rng(11).normal(size=(5, 5))
    scores, ratios = similarity.principal_components(vec_df(spark, x), "id", "z", 5, 3)
    pc = np.stack(scores.toPandas().sort_values("id")["pc"])
    s = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(s.T @ s / len(s))[::-1]
    assert np.allclose(pc.mean(0), 0, atol=1e-9) and np.allclose(pc.std(0), 1) and np.allclose(ratios, values[:3] / values.sum())


def test_bayesian_regression_equals_numpy(spark):
    rng = np.random.default_rng(12)
    z, w = rng.normal(size=(150, 4)), np.array([1.0, -2.0, 0.5, 0.0])
    y = z @ w + rng.normal(size=150)
    df = vec_df(spark, z).join(spark.createDataFrame(list(enumerate(map(float, y))), "id INT, y DOUBLE"), "id")
    mean, cov, noise = stats.bayesian_linear(df, "z", "y", 4)
    s2 = y.var() * 0.1 + 1e-6
    want = np.linalg.inv(np.eye(4) + z.T @ z / s2)
    assert np.allclose(cov, want) and np.allclose(mean, want @ z.T @ y / s2) and noise == pytest.approx(s2)
    out = stats.predict_linear(df, "z", "y", mean, cov, noise).toPandas().sort_values("id")
    assert np.allclose(out["sd"], np.sqrt(np.sum(z @ want * z, 1) + s2)) and np.allclose(out["residual"], y - z @ mean)


def test_mantel_equals_all_pairs(spark):
    rng = np.random.default_rng(13)
    x, y = rng.normal(size=(60, 5)), rng.integers(0, 9, 60).astype(float)
    df = vec_df(spark, x).join(spark.createDataFrame(list(enumerate(map(float, y))), "id INT, y DOUBLE"), "id")
    k, s = x @ x.T, 1 - np.abs(y[:, None] - y[None]) / np.abs(y[:, None] - y[None]).max()
    i = np.triu_indices(60, 1)
    got = stats.mantel(df, "z", "y", "id").first()
    assert got["similarity_r"] == pytest.approx(np.corrcoef(k[i], s[i])[0, 1], abs=1e-9)
    d = 1 - (k - k.min()) / (k.max() - k.min())
    assert got["distance_r"] == pytest.approx(np.corrcoef(d[i], 1 - s[i])[0, 1], abs=1e-9)


def test_log_gamma(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 10.0, 300.0]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select("x", stats.log_gamma(F.col("x")).alias("g"))
    assert all(r["g"] == pytest.approx(math.lgamma(r["x"]), abs=1e-10, rel=1e-12) for r in df.collect())


def test_participation_rank(spark):
    assert stats.participation_rank(vec_df(spark, np.eye(5)), "z", 5) == pytest.approx(5.0)


# -- cleaning, traits, sampling -------------------------------------------------------------


def test_range_assertion_fails_with_the_value(spark):
    df = spark.createDataFrame([(0, 0, -1500.0)], "row INT, col INT, value DOUBLE")
    with pytest.raises(Exception, match="-1500"):
        clean.assert_range(df, -1000.0).collect()


def test_clips_keep_missing_values_missing(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (800.0,)], "x DOUBLE")
    x = F.col("x")
    got = df.select(links.clip(x, -1, 1).alias("c"), links.softplus(x).alias("s"), links.power(x, 0.5, "clip").alias("p"), links.power(x, 0.5).alias("m")).collect()
    assert got[0] == (None, None, None, None)
    assert got[1]["c"] == -1.0 and got[1]["p"] == 0.0 and got[1]["m"] is None
    assert got[2]["s"] == 800.0


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0)], "a DOUBLE, b DOUBLE")
    got = clean.standardize(df, ["a", "b"]).orderBy("b").collect()
    assert [r["a"] for r in got] == [0.0, 0.0] and got[1]["b"] == pytest.approx(math.sqrt(0.5))


def test_required_member(spark):
    df = spark.createDataFrame([(1,), (2,)], "k INT")
    assert traits.require_member(df, "k", 2).count() == 2
    with pytest.raises(Exception, match="k=3"):
        traits.require_member(df, "k", 3).collect()


def test_block_quantiles_of_an_empty_block(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (2, 0, None)], "row INT, col INT, value DOUBLE")
    got = {(r["row"], r["band"]): r["value"] for r in grid.block_quantiles(df, 2, [0.5, 0.75]).collect()}
    assert got == {(0, 1): 2.0, (0, 2): 2.5, (1, 1): None, (1, 2): None}


def test_pareto_front_keeps_equal_points(spark):
    pts = [(1, 5.0, 0.5), (2, 5.0, 0.5), (3, 6.0, 0.5), (4, 6.0, 0.5), (5, 7.0, 0.9), (6, 4.0, 0.1), (7, 3.0, 0.1)]
    got = {r["id"] for r in sampling.pareto_front(spark.createDataFrame(pts, "id INT, rank DOUBLE, rmse DOUBLE"), "rank", "rmse").collect()}
    assert got == {3, 4, 5, 6}


def test_blocks_follow_array_split(spark):
    for n, b in ((10, 8), (64, 8), (5, 8), (23, 4)):
        want = [i for i, part in enumerate(np.array_split(np.arange(n), b)) for _ in part]
        df = spark.range(n).select("id", sampling.block_of(F.col("id"), F.lit(n), b).alias("b"))
        assert [r["b"] for r in df.orderBy("id").collect()] == want


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumn("g", F.col("id") % 3)
    picks = [{r["id"] for r in sampling.sample_per_group(df.repartition(n), "g", ["id"], 50, 1).collect()} for n in (2, 9)]
    assert picks[0] == picks[1] and len(picks[0]) == 150


def test_patristic_distance_of_a_hand_made_tree(spark):
    edges = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 2.0), ("p", "root", 4.0), ("c", "root", 8.0)], "child STRING, parent STRING, length DOUBLE")
    got = {r["node"]: r["distance"] for r in traits.patristic_distance(edges, "a").collect()}
    assert got == {"a": 0.0, "b": 3.0, "c": 13.0}


def test_saved_mask_wins(spark):
    layers = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "row INT, col INT, value DOUBLE")
    saved = spark.createDataFrame([(9, 9)], "row INT, col INT")
    assert scans.load_mask(layers).collect() == [(0, 0)] and scans.load_mask(layers, saved).collect() == [(9, 9)]


def test_vector_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0, None], [1.0, 1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.complete(F.col("a")).alias("c")).collect()
    assert (got[0]["d"], got[0]["c"]) == (11.0, True) and (got[1]["d"], got[1]["c"]) == (None, False)
