"""Cleaning, masks, normalisation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scans import SENTINELS


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery (no join, no driver round trip)."""
    return df.select(F.struct("*").alias("s")).scalar()


def replace_fill(df: DataFrame, fills: Sequence[float], column: str = "value") -> DataFrame:
    """Declared fill values become missing."""
    return df.withColumn(column, F.when(~F.col(column).isin(*[float(f) for f in fills]), F.col(column)))


def replace_sentinels(df: DataFrame, column: str = "value") -> DataFrame:
    return replace_fill(df, SENTINELS, column)


def range_report(df: DataFrame, low: float, column: str = "value") -> DataFrame:
    """One row: checked values, values below ``low``, the smallest one and where it is."""
    bad = F.col(column) < low
    return df.agg(
        F.count(column).alias("n_checked"),
        F.count_if(bad).alias("n_bad"),
        F.min(F.when(bad, F.struct(F.col(column), F.col("row"), F.col("col")))).alias("e"),
    ).select("n_checked", "n_bad", F.col(f"e.{column}").alias("min_bad"), F.col("e.row").alias("bad_row"), F.col("e.col").alias("bad_col"))


def assert_range(df: DataFrame, low: float, column: str = "value") -> DataFrame:
    """Fail the job on the first non-missing value below ``low``."""
    message = F.concat(F.lit(f"{column} below {low}: "), F.col(column).cast("string"))
    return df.withColumn(column, F.when(F.col(column) < low, F.raise_error(message).cast("double")).otherwise(F.col(column)))


def apply_mask(df: DataFrame, grid: DataFrame, column: str = "value") -> DataFrame:
    """Ocean cells keep their row but lose their value."""
    joined = df.join(grid.select("row", "col", "is_ocean"), ["row", "col"], "left")
    return joined.withColumn(column, F.when(F.coalesce("is_ocean", F.lit(0)) == 0, F.col(column))).drop("is_ocean")


def ocean_mask(bands: DataFrame) -> DataFrame:
    """(row, col, is_ocean): a cell is ocean when every band is missing."""
    return bands.groupBy("row", "col").agg((F.count("value") == 0).cast("int").alias("is_ocean"))


def any_valid(bands: DataFrame) -> DataFrame:
    return bands.groupBy("row", "col").agg(F.count("value").alias("_n")).where("_n > 0").select("row", "col")


def all_valid(bands: DataFrame, n_bands: int, band: str = "band") -> DataFrame:
    """Cells with a value in each of ``n_bands`` distinct bands and no missing value."""
    return (
        bands.groupBy("row", "col")
        .agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col(band))).alias("_n"), F.count_if(F.col("value").isNull()).alias("_m"))
        .where((F.col("_n") == n_bands) & (F.col("_m") == 0))
        .select("row", "col")
    )


def strict_mask(*masks: DataFrame) -> DataFrame:
    """Cells in every mask."""
    out = masks[0]
    for mask in masks[1:]:
        out = out.join(mask, ["row", "col"], "left_semi")
    return out


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(columns))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-score with the sample deviation; a constant or empty column becomes 0.0."""
    stats = one_row(df.agg(*[e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]))
    out = {}
    for c in columns:
        sd = stats[f"s_{c}"]
        out[c] = F.when(F.coalesce(sd, F.lit(0.0)) == 0.0, F.lit(0.0)).otherwise((F.col(c) - stats[f"m_{c}"]) / sd)
    return df.withColumns(out)


def normalize_by(df: DataFrame, reference: DataFrame, key: str, column: str, sample: bool = True, eps: float = 1e-6) -> DataFrame:
    """(x - mean) / (sd + eps) with the statistics of another slice, per ``key``."""
    sd = F.stddev_samp if sample else F.stddev_pop
    stats = reference.groupBy(key).agg(F.avg(column).alias("_mu"), sd(column).alias("_sd"))
    return df.join(stats, key, "left").withColumn(column, (F.col(column) - F.col("_mu")) / (F.col("_sd") + eps)).drop("_mu", "_sd")


def scale_unit(df: DataFrame, bounds: DataFrame, key: str, column: str) -> DataFrame:
    """Clip to [lo, hi] of the channel and scale to [0, 1]."""
    joined = df.join(bounds, key)
    width = F.col("hi") - F.col("lo")
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(column) - F.col("lo")) / width))
    return joined.withColumn(column, F.when(F.col(column).isNull(), F.lit(None)).when(width > 0, scaled).otherwise(0.0)).drop("lo", "hi")
