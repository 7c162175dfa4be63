"""Order statistics over whole tables without a one-task window.

A window ordered over a whole table would run in a single task, and a window over a
group that holds a third of all rows is hardly better. Here Spark's range partitioner
cuts the sort key into as many ranges as the session has shuffle partitions; each row keeps
the number of its range, and the table is made durable once, so that all that follows
sees the same ranges. Running totals are taken inside each range and shifted by the totals
of the ranges before it. Nothing of the table, and no boundary, reaches the driver.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.session import durable


def in_ranges(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_rng``, the number of its range of ``order``, ascending. The input is evaluated for a
    sample of keys and once more to be dealt."""
    ranges = ranges or max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return durable(df.repartitionByRange(ranges, *[F.col(c) for c in order]).withColumn("_rng", F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    weights: dict[str, Column],
    group: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Inclusive running sums in ``order`` (unique inside ``group``), one column per weight."""
    part = in_ranges(df.withColumns({f"_w_{n}": w for n, w in weights.items()}), [*group, *order], ranges)
    inside = Window.partitionBy(*group, "_rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.groupBy(*group, "_rng").agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in weights])
    offsets = offsets.select(*group, "_rng", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in weights])
    shifted = part.withColumns({f"_i_{n}": F.sum(f"_w_{n}").over(inside) for n in weights}).join(offsets, [*group, "_rng"])
    return shifted.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in weights])


def running_min_before(df: DataFrame, order: Sequence[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Smallest ``value`` over the rows strictly before this one in a unique ``order``."""
    part = in_ranges(df, order, ranges)
    inside = Window.partitionBy("_rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range (at most ``ranges``), so this window is small by construction
    offsets = part.groupBy("_rng").agg(F.min(value).alias("_m")).select("_rng", F.min("_m").over(before).alias("_o"))
    shifted = part.withColumn("_i", F.min(value).over(inside)).join(offsets, "_rng")
    return shifted.select(*df.columns, F.least("_i", "_o").alias(name))


def row_numbers(df: DataFrame, order: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """1-based position in a total order over the whole table; ``order`` must be unique."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, ranges=ranges)


def average_ranks(df: DataFrame, value: str, name: str, group: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Ascending ranks with ties averaged; missing values keep a missing rank.

    Equal values are counted before any ordering, so a value shared by a third of the
    rows is one row of the ordered table.
    """
    keys = [*group, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = running_totals(counts, [value], {"_cum": F.col("_n")}, group=group, ranges=ranges)
    ranks = ranked.select(*keys, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, keys, "left")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    group: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, per group or global (one row).

    Values are reduced to (value, count) first; ranks come from range-cut running
    totals, so neither a hot group nor the whole table lands in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    cum = running_totals(counts, [value], {"_cum": F.col("_n")}, group=group, ranges=ranges)
    totals = cum.groupBy(*group).agg(F.max("_cum").alias("_size"))
    size = F.col("_size")
    cum = cum.join(totals, list(group)) if group else cum.withColumn("_size", totals.scalar())
    aggs = []
    for i, p in enumerate(probs):
        pos = (size - 1) * F.lit(float(p))
        aggs.append(F.min(F.when(F.col("_cum") > F.floor(pos), F.col(value))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(value))).alias(f"_hi{i}"))
    found = cum.groupBy(*group).agg(F.max("_size").alias("_size"), *aggs)
    out = list(group)
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = (F.col("_size") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * frac).alias(name))
    return found.select(*out)
