"""Cases beyond the synthetic data: small hulls, missing elements, quoted headers, deep trees."""
from __future__ import annotations

import pytest

from gridloom.operators import spatial, stats, traits
from gridloom.sources import scans


@pytest.mark.parametrize("points, inside", [([], 0), ([(1, 1)], 1), ([(0, 0), (2, 2)], 3), ([(0, 0), (1, 1), (2, 2)], 3), ([(0, 0), (2, 0), (2, 2), (0, 2)], 9)])
def test_small_hulls(spark, points, inside):
    cells = spark.createDataFrame([(float(r), float(c)) for r in range(6) for c in range(6)], "x double, y double")
    hull = spatial.convex_hull(spark.createDataFrame([(float(a), float(b)) for a, b in points], "x double, y double"), "x", "y")
    assert spatial.inside_hull(cells, hull, "x", "y").where("inside").count() == inside
    assert spatial.distance_to_hull(cells, hull, "x", "y").where("distance = 0").count() == inside


@pytest.mark.parametrize("parts", [1, 3])
def test_gram_skips_incomplete_rows(spark, parts):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, None],), ([3.0, float("nan")],), (None,), ([0.0, 1.0],)], "v array<double>").repartition(parts)
    assert {(r.i, r.j): r.g for r in stats.gram(rows, "v").collect()} == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 2.0, (1, 1): 5.0}


def test_quoted_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"visit","route"\n1,2\n')
    (tmp_path / "b.csv").write_text("visit,route\n3,4\n")
    rows, skipped = scans.scan_csv_tolerant(spark, [str(tmp_path)], ["visit", "route"])
    assert sorted((r.visit, r.route) for r in rows.collect()) == [("1", "2"), ("3", "4")]
    assert skipped.count() == 0


def test_header_is_the_first_line_only(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('"route","visit, long","visit"\n1,x,2\n')
    (tmp_path / "late.csv").write_text("note,other\nvisit,route\n")
    rows, skipped = scans.scan_csv_tolerant(spark, [str(tmp_path)], ["visit", "route"])
    assert [(r.visit, r.route) for r in rows.collect()] == [("2", "1")]
    assert sorted(r.path.rsplit("/", 1)[1] for r in skipped.collect()) == ["late.csv"]


def test_parquet_files_broken_and_empty(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    # incompressible values in many row groups, so that the break lies behind readable ones
    table = pa.table({"x": np.random.default_rng(1).normal(size=40000)})
    for name, rows in (("whole one", table), ("broken", table), ("empty", table.slice(0, 0))):
        pq.write_table(rows, tmp_path / f"{name}.parquet", row_group_size=4000, use_dictionary=False)
    raw = bytearray((tmp_path / "broken.parquet").read_bytes())
    raw[len(raw) // 2:len(raw) // 2 + 40000] = b"\xff" * 40000
    (tmp_path / "broken.parquet").write_bytes(bytes(raw))
    (tmp_path / "text.parquet").write_text("no parquet")
    rows, skipped = scans.scan_parquet_tolerant(spark, [str(tmp_path)], "x DOUBLE")
    assert 40000 <= rows.agg({"x": "count"}).first()[0] < 80000
    assert sorted(r.path.rsplit("/", 1)[1] for r in skipped.collect()) == ["broken.parquet", "text.parquet"]


def test_cyclic_edges_are_refused(spark):
    with pytest.raises(ValueError):
        traits.ancestors(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "child string, parent string, length double"))
