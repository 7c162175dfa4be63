"""What joins and tasks hold must not follow Spark's size estimates of exploded tables."""
from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.operators import focal, similarity, spatial, temporal, triangulation
from gridloom.plans import catalog, q_similarity, views  # noqa: F401 (catalog registers the queries)
from gridloom.plans.registry import ENTRIES
from gridloom.plans.views import Views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exploded(spark):
    land = spark.range(6).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("col"))
    stack = focal.directional(focal.isotropic(1, 16.0, 20.0, 1.0), [0.0, 30.0, 1e9], 16.0)
    q = land.select("row", "col", F.explode(F.array(*[F.lit(k) for k in stack])).alias("kernel"), F.lit(0.5).alias("Q"))
    return land, stack, q


def test_redistribution_broadcasts_no_exploded_table(spark):
    land, stack, q = exploded(spark)
    out = focal.redistribute(land.withColumn("value", F.lit(1.0)), land, stack, q)
    assert "BroadcastHashJoin" not in plan(out)


def test_outgoing_risk_broadcasts_no_exploded_table(spark):
    land, stack, q = exploded(spark)
    assert "BroadcastHashJoin" not in plan(focal.outgoing_risk(q, land, stack))


def test_summed_risk_broadcasts_no_exploded_table(spark, tmp_path):
    rows = [(k, f"s{k}", 0, 1.0) for k in range(6)]
    spark.createDataFrame(rows, "s_suppkey INT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE").write.parquet(f"{tmp_path}/supplier.parquet")
    out = ENTRIES["W25b_outgoing_risk_summed"].build(Views(spark, str(tmp_path)))
    assert "BroadcastHashJoin" not in plan(out)
    assert out.count() == 6 * 32


def test_bio_years_are_not_dealt_by_year(spark):
    rows = [("a", y, m) for y in (2000, 2001) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "var STRING, year INT, month INT")
    out = temporal.complete_bio_years(df, 12, "var")
    assert "BroadcastHashJoin" in plan(out)
    assert sorted({r["bio_year"] for r in out.collect()}) == [2001]


def test_species_axis_is_broadcast(spark):
    df = spark.createDataFrame([(c, s, w, 1.0 + w) for c in range(5) for s in "ab" for w in range(3)], "cell INT, species STRING, week INT, x DOUBLE")
    vec, width, n = similarity.sparse_vectors(df, "cell")
    assert "BroadcastHashJoin" in plan(vec) and (width, n) == (104, 2)
    assert all(r["vec_idx"] == [0, 1, 2, 52, 53, 54] for r in vec.collect())


def test_pairs_take_the_vectors_of_their_cells(spark):
    vecs = spark.createDataFrame([(c, [c], [1.0 + c]) for c in range(6)], "cell INT, vec_idx ARRAY<INT>, vec_val ARRAY<DOUBLE>")
    pairs = spark.createDataFrame([(1, 0, 3), (2, 3, 3), (3, 5, 0)], "pair LONG, cell_a INT, cell_b INT")
    got = {r["pair"]: (r["vec_idx_a"], r["vec_val_a"], r["vec_idx_b"], r["vec_val_b"]) for r in similarity._with_vectors(pairs, vecs, "cell").collect()}
    assert got == {1: ([0], [1.0], [3], [4.0]), 2: ([3], [4.0], [3], [4.0]), 3: ([5], [6.0], [0], [1.0])}


def test_linear_filling_reads_its_field_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = [(r, c, float(r + c)) for r in range(12) for c in range(12) if (r * 5 + c) % 3]
    field = spark.createDataFrame(rows, "row INT, col INT, v DOUBLE").mapInPandas(count, "row INT, col INT, v DOUBLE")
    land = spark.createDataFrame([(r, c) for r in range(12) for c in range(12)], "row INT, col INT")
    got = {(r["row"], r["col"]): r["v"] for r in triangulation.fill_linear(field, land, ["v"], 4).collect()}
    assert read.value == len(rows)
    assert all(v is None or abs(v - r - c) < 1e-9 for (r, c), v in got.items()) and len(got) == 144


def brute_nearest(targets, sources, k):
    out = set()
    for y, r, c in targets:
        best = sorted(((r - a) ** 2 + (c - b) ** 2, a, b) for z, a, b in sources if z == y)[:k]
        out |= {(y, r, c, a, b, i + 1) for i, (_, a, b) in enumerate(best)}
    return out


def cells(spark, rows):
    return spark.createDataFrame(rows, "year INT, row INT, col INT")


def test_near_targets_never_descend(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a target with near sources went to the pyramid")

    monkeypatch.setattr(spatial, "_descend", refuse)
    sources = [(y, r, c) for y in (1, 2) for r in range(-70, 70, 3) for c in range(0, 9, 1 + y)]
    targets = [(y, r, c) for y in (1, 2) for r in range(-70, 70, 7) for c in (-1, 0, 5)]
    got = spatial.nearest(cells(spark, targets * 2), cells(spark, sources * 2), 5, layers=["year"])
    assert {tuple(x) for x in got.select("year", "row", "col", "n_row", "n_col", "rank").collect()} == brute_nearest(targets, sources, 5)
    assert got.count() == 5 * len(targets)


def test_near_and_far_targets_meet_all_their_neighbours(spark):
    sources = [(1, 0, 0), (1, 0, 1), (1, 63, 64), (1, 64, 63), (1, 300, -200), (2, 5, 5)]
    targets = [(1, 0, 0), (1, 8, 8), (1, 64, 64), (1, 200, 0), (2, -400, 7), (3, 0, 0)]
    odd = [(None, 0, 0), (1, None, 0), (1, 0, None)]
    got = spatial.nearest(cells(spark, targets + odd), cells(spark, sources + odd), 2, layers=["year"])
    assert {tuple(x) for x in got.select("year", "row", "col", "n_row", "n_col", "rank").collect()} == brute_nearest(targets, sources, 2)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "int", "int", "int", "int", "double", "int"]


def shop(spark, folder):
    """300 lines of 12 suppliers and 40 parts over seven years, one part with a third of them."""
    rows = [(i, i % 12, 7 if i % 3 == 0 else i % 40, 1 + i % 7, float(i % 50), i % 11 / 100, i % 9 / 100, datetime.date(1995 + i % 7, 1 + i % 12, 1 + i % 28)) for i in range(300)]
    schema = "l_orderkey LONG, l_suppkey LONG, l_partkey LONG, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_shipdate DATE"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(p, f"brand{p % 3}") for p in range(40)], "p_partkey LONG, p_brand STRING").write.parquet(f"{folder}/part.parquet")
    return Views(spark, str(folder))


@pytest.mark.parametrize("name", ["W8_circular_smoothing", "W9_smoothed_hellinger", "A12_epoch_means", "P35_effective_growth"])
def test_tasks_follow_the_lines(spark, tmp_path, monkeypatch, name):
    v = shop(spark, tmp_path)
    monkeypatch.setattr(views, "DEAL_ROWS", 10)
    out = ENTRIES[name].build(v)
    assert out.rdd.getNumPartitions() == 30
    monkeypatch.setattr(views, "DEAL_ROWS", 1000)
    other = ENTRIES[name].build(v)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, other.collect())) != []


def test_python_gets_the_vectors_of_few_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "DEAL_ROWS", 10)
    vec, width, n = q_similarity.sparse(shop(spark, tmp_path))
    assert vec.rdd.getNumPartitions() == 30 and (width, n) == (156, 3)
    assert sorted(r["cell"] for r in vec.collect()) == list(range(12))
