"""Completeness and consistency audits of layer collections."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: n rows, distinct keys per side, and whether they fill the product."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(left).alias("n_left"),
        F.countDistinct(right).alias("n_right"),
    ).withColumn("complete", F.col("n_rows") == F.col("n_left") * F.col("n_right"))


def missing_combinations(df: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right) pairs of the full product that have no row.

    ``right`` is a short calendar dimension (weeks, months); its distinct values travel
    as one array, so the product is an explode, not a join.
    """
    calendar = df.agg(F.collect_set(right)).scalar()
    full = df.select(left).distinct().select(left, F.explode(calendar).alias(right))
    return full.join(df.select(left, right), [left, right], "left_anti")


def month_calendar(df: DataFrame, var: str, first: str, last: str) -> DataFrame:
    """variable x month calendar from ``first`` to ``last``."""
    months = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month")))
    return df.select(var).distinct().select(var, months.alias("month"))


def audit_calendar(present: DataFrame, var: str, first: str, last: str, min_length: int) -> DataFrame:
    """(var, month, status) with status ok / missing / corrupt."""
    expected = month_calendar(present, var, first, last)
    return expected.join(present, [var, "month"], "left").select(
        var, "month",
        F.when(F.col("length").isNull(), "missing").when(F.col("length") < min_length, "corrupt").otherwise("ok").alias("status"),
    )


def work_list(present: DataFrame, var: str, first: str, last: str, min_length: int) -> DataFrame:
    """Items to fetch again: missing united with corrupt."""
    audit = audit_calendar(present, var, first, last, min_length)
    missing = audit.where("status = 'missing'").select(var, "month")
    corrupt = audit.where("status = 'corrupt'").select(var, "month")
    return missing.unionByName(corrupt)


def metadata_consistency(meta: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, n_values, consistent) over all layers."""
    counts = meta.agg(*[F.countDistinct(f).alias(f) for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_values")) for f in fields])).alias("p")
    return counts.select(pairs).select("p.field", "p.n_values", (F.col("p.n_values") == 1).alias("consistent"))
