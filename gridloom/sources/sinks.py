"""Sinks: CSV, yearly partitions, land-only slices, resumable writes."""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import shared_dir


def staging(spark: SparkSession, label: str) -> str:
    """A fresh output location in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/gridloom_{label}_{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    df.write.options(header=True, encoding=encoding).csv(path)


def write_yearly(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One directory per year. Rows are clustered by year and grid band, so a writing task
    holds few years and a year with a third of all rows still spreads over many tasks."""
    clustered = df.repartition(F.col("year"), F.floor(F.col("row") / 64)) if "row" in df.columns else df.repartition("year")
    clustered.write.mode(mode).partitionBy("year").parquet(path)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """(year, run, n_rows) of the years that are whole; of several runs that wrote one year the first by name counts."""
    try:
        listed = spark.read.schema("year INT, run STRING, n_rows BIGINT").parquet(f"{path}/_whole")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "year INT, run STRING, n_rows BIGINT")
    return listed.groupBy("year").agg(F.min_by("run", "run").alias("run"), F.min_by("n_rows", "run").alias("n_rows"))


def stored_years(spark: SparkSession, path: str) -> DataFrame:
    """The years that ``write_missing_years`` has finished. What a broken run left behind is not read."""
    whole = _manifest(spark, path).select("year", "run")
    return spark.read.option("basePath", path).parquet(f"{path}/run=*").join(whole, ["year", "run"], "left_semi").drop("run")


def write_missing_years(df: DataFrame, path: str) -> DataFrame:
    """Write only the years that are not whole yet; returns the full stored table.

    A run writes its files to a folder of its own and then, from what lies there, one line per year to a list of whole
    years. A run that breaks off before that has written nothing that counts, and the next one does its years again.
    """
    spark = df.sparkSession
    todo = df.join(_manifest(spark, path).select("year"), "year", "left_anti")
    run = uuid.uuid4().hex
    write_yearly(todo, f"{path}/run={run}")
    try:
        written = spark.read.parquet(f"{path}/run={run}")
    except AnalysisException as problem:  # there was nothing to do
        if problem.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return stored_years(spark, path)
    whole = written.groupBy(F.col("year").cast("int").alias("year")).agg(F.lit(run).alias("run"), F.count("*").alias("n_rows"))
    whole.write.mode("append").parquet(f"{path}/_whole")
    return stored_years(spark, path)


def write_land_slices(df: DataFrame, land: DataFrame, path: str) -> None:
    """Land cells only, one directory per year."""
    write_yearly(df.join(land, ["row", "col"], "left_semi"), path)
