"""Survey tables: quality filters, zero-fill, grid assignment, pseudo-zeros."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import coarse


def quality_visits(effort: DataFrame, first_year: int, last_year: int, run_type: int = 1, protocol: int | None = None) -> DataFrame:
    """Runs of the wanted type in the year range; with ``protocol`` also of that run protocol (column ``rpid``)."""
    good = effort.where((F.col("run_type") == run_type) & F.col("year").between(first_year, last_year))
    return good if protocol is None else good.where(F.col("rpid") == protocol)


def zero_fill_counts(visits: DataFrame, counts: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Every quality visit is kept; an undetected species counts 0."""
    return visits.join(counts, list(keys), "left").fillna(0, subset=[count])


def native_range(df: DataFrame, last_year: int, ncols: int, share: float = 0.66) -> DataFrame:
    return df.where((F.col("year") <= last_year) & (F.col("n") > 0) & (F.col("col") < int(ncols * share)))


def in_bounds(df: DataFrame, nrows: Column, ncols: Column, land: DataFrame) -> DataFrame:
    """Index inside the grid and on land."""
    inside = F.col("row").between(F.lit(0), nrows - 1) & F.col("col").between(F.lit(0), ncols - 1)
    return df.where(inside).join(land, ["row", "col"], "left_semi")


def time_index(df: DataFrame, first_year: int, last_year: int) -> DataFrame:
    return df.where(F.col("year").between(first_year, last_year)).withColumn("t", F.col("year") - first_year)


def coarsen(df: DataFrame, factor: int) -> DataFrame:
    return df.withColumns({"row": coarse(F.col("row"), factor), "col": coarse(F.col("col"), factor)})


def pseudo_zeros(sites: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Each site in each year with count 0; years are generated per row."""
    return sites.select("row", "col", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("year"), F.lit(0).cast("bigint").alias("n"))


def merge_observations(pseudo: DataFrame, real: DataFrame) -> DataFrame:
    """Pseudo and real observations with an explicit flag in place of a position."""
    return pseudo.withColumn("is_pseudo", F.lit(True)).unionByName(real.withColumn("is_pseudo", F.lit(False)))


def sampling_density(real: DataFrame, land: DataFrame) -> DataFrame:
    """One row: distinct real cells, land cells, and their ratio."""
    n_real = real.select("row", "col").distinct().agg(F.count("*").alias("n_sites"))
    return n_real.withColumn("n_land", land.agg(F.count("*")).scalar()).withColumn("density", F.col("n_sites") / F.col("n_land"))
