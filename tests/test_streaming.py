"""Streams fed file by file must equal the batch fold; late periods are dropped and counted."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.operators import temporal
from gridloom.streaming import operators as ops
from gridloom.streaming import runs


def test_state_over_micro_batches_equals_batch(spark, tmp_path):
    schema = "k INT, t BIGINT, x DOUBLE"
    rows = [(k, t, None if (k + t) % 4 == 0 else float(k * t % 7)) for t in range(12) for k in range(3)]
    for i in range(4):
        spark.createDataFrame(rows[i * 9:(i + 1) * 9], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.folder_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    got, counters = runs.drain(ops.ema_state(stream, "k", "t", "x", 0.3), "t1")
    want = temporal.ema(spark.createDataFrame(rows, schema), ["k"], "t", "x", 0.3)
    a = {(r["k"], r["t"]): r["state"] for r in got.collect()}
    b = {(r["k"], r["t"]): r["state"] for r in want.collect()}
    assert a == b and counters["input_rows"] == len(rows)


def test_late_period_is_counted_not_folded(spark, tmp_path):
    schema = "k INT, t BIGINT, x DOUBLE"
    path = str(tmp_path / "in")
    for rows in ([(1, 5, 10.0)], [(1, 3, 99.0), (1, 6, 20.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    got, _ = runs.drain(ops.ema_state(runs.folder_stream(spark, path, schema, 1), "k", "t", "x", 0.5), "t2")
    assert sorted((r["t"], r["state"], r["late"]) for r in got.collect()) == [(5, 10.0, 0), (6, 15.0, 1)]


def test_last_windows_come_out(spark, tmp_path):
    path = str(tmp_path / "in")
    for day in (1, 2, 3):
        spark.sql(f"SELECT id % 2 AS k, timestamp'2024-01-0{day} 06:00:00' AS ts FROM range(3)").coalesce(1).write.mode("append").parquet(path)
    source = runs.folder_stream(spark, path, "k BIGINT, ts TIMESTAMP", files_per_batch=1)

    def daily(stream):
        return ops.rollup(stream, "ts", "1 day", "1 day", ["k"], [F.count("*").alias("n")]).select("k", F.dayofmonth("w.start").alias("day"), "n")

    rows, counters = runs.drain_windows(source, "ts", daily, "t5")
    assert sorted(tuple(r) for r in rows.collect()) == [(k, d, 2 - k) for k in (0, 1) for d in (1, 2, 3)]
    assert counters["input_rows"] == 9 and counters["late_rows"] == 0


def test_duplicates_and_late_rows(spark, tmp_path):
    schema = "id INT, ts TIMESTAMP"
    path = str(tmp_path / "in")
    parts = [
        "(1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 00:00:30'), (2, timestamp'2024-01-01 00:01:00')",
        "(3, timestamp'2024-01-03 00:00:00')",
        # late rows are judged by the watermark of the batch before
        "(6, timestamp'2024-01-03 00:00:05')",
        "(4, timestamp'2024-01-01 00:00:00'), (3, timestamp'2024-01-03 00:00:10'), (5, timestamp'2024-01-03 00:00:20')",
    ]
    for p in parts:
        spark.sql(f"SELECT * FROM VALUES {p} AS t(id, ts)").coalesce(1).write.mode("append").parquet(path)
    stream = runs.folder_stream(spark, path, schema, files_per_batch=1)
    got, counters = runs.drain(ops.deduplicate(stream, "ts", "10 minutes", ["id"]), "t3")
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 5, 6]
    assert counters["late_rows"] == 1


def test_observed_violations(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(0, 0, -5000.0), (0, 1, -9999.0), (0, 2, 3.0), (9, 9, 1.0)], "row INT, col INT, value DOUBLE").write.parquet(path)
    grid = spark.createDataFrame([(0, c, 0) for c in range(3)], "row INT, col INT, is_ocean INT")
    got, counters = runs.drain(ops.masked_clean(runs.folder_stream(spark, path, "row INT, col INT, value DOUBLE"), grid, -1000.0), "t4")
    assert counters["range.violations"] == 1 and counters["range.rows"] == 3
    assert {r["col"]: r["value"] for r in got.collect()} == {0: -5000.0, 1: None, 2: 3.0}
    assert pytest.approx(got.agg(F.count("value")).first()[0]) == 2
