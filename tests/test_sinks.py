"""A yearly table that is written in several runs, some of which break off."""
from __future__ import annotations

import pytest

from gridloom.sources import sinks


def table(spark, years):
    return spark.createDataFrame([(r, y, float(r * y)) for y in years for r in range(70)], "row INT, year INT, v DOUBLE")


def test_broken_run_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "years")
    sinks.write_missing_years(table(spark, [1995, 1996]), path)

    def broken(df, where, mode="errorifexists"):
        df.where("year < 1998 AND row < 9").write.partitionBy("year").parquet(where)  # part of one year, nothing of the next
        raise RuntimeError("lost")

    with monkeypatch.context() as half:
        half.setattr(sinks, "write_yearly", broken)
        with pytest.raises(RuntimeError):
            sinks.write_missing_years(table(spark, [1995, 1996, 1997, 1998]), path)
    assert {r["year"]: r["n"] for r in sinks.stored_years(spark, path).groupBy("year").count().withColumnRenamed("count", "n").collect()} == {1995: 70, 1996: 70}
    stored = sinks.write_missing_years(table(spark, [1995, 1996, 1997, 1998]), path)
    assert sorted(stored.select("row", "year", "v").collect()) == sorted(table(spark, [1995, 1996, 1997, 1998]).collect())


def test_whole_years_are_left_alone_and_nothing_to_do_is_fine(spark, tmp_path):
    path = str(tmp_path / "years")
    sinks.write_missing_years(table(spark, [2000]), path)
    changed = table(spark, [2000]).selectExpr("row", "year", "v + 1 AS v")
    stored = sinks.write_missing_years(changed, path)
    assert sorted(stored.select("row", "year", "v").collect()) == sorted(table(spark, [2000]).collect())


def test_same_year_by_two_runs_counts_once(spark, tmp_path):
    path = str(tmp_path / "years")
    sinks.write_missing_years(table(spark, [2000]), path)
    other = table(spark, [2000])
    sinks.write_yearly(other, f"{path}/run=zzz")
    other.groupBy("year").count().selectExpr("year", "'zzz' AS run", "count AS n_rows").write.mode("append").parquet(f"{path}/_whole")
    assert sinks.stored_years(spark, path).count() == 70
