"""Time series per cell: interpolation, smoothing, exponential state, pooling.

Series are reduced to one row per (key, period) before any window, so a window never sees
more rows than the calendar has periods, whatever the number of raw records of a key.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.focal import gaussian_weights

#: Fixed smoothing constant of the environment state (ten-year memory).
EMA_ALPHA = 1.0 - math.exp(-1.0 / 10.0)


def dense_periods(df: DataFrame, keys: Sequence[str], time: str, first: int, last: int) -> DataFrame:
    """Every key in every period, values missing where there was no row."""
    slots = df.select(*keys).distinct().withColumn(time, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return slots.join(df, [*keys, time], "left")


def _anchors(keys: Sequence[str], time: str, value: str) -> tuple[Column, Column]:
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("x")))
    order = Window.partitionBy(*keys).orderBy(time)
    prev = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(point, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return prev, nxt


def _between(t: Column, p: Column, n: Column) -> Column:
    w = (t - p["t"]) / (n["t"] - p["t"])
    return (1 - w) * p["x"] + w * n["x"]


def bracket_interpolate(anchors: DataFrame, keys: Sequence[str], time: str, value: str, first: int, last: int) -> DataFrame:
    """Linear between the neighbouring anchor years, clamped at both ends."""
    prev, nxt = _anchors(keys, time, value)
    d = dense_periods(anchors, keys, time, first, last).withColumns({"_p": prev, "_n": nxt})
    p, n = F.col("_p"), F.col("_n")
    x = (
        F.when(p.isNull(), n["x"]).when(n.isNull(), p["x"]).when(p["t"] == n["t"], p["x"])
        .otherwise(_between(F.col(time), p, n))
    )
    return d.select(*keys, time, x.alias(value))


def linear_interpolate(anchors: DataFrame, keys: Sequence[str], time: str, value: str, first: int, last: int) -> DataFrame:
    """Annual linear interpolation, extrapolating with the two nearest anchors; a single anchor
    stays constant, a key without anchors stays missing."""
    prev, nxt = _anchors(keys, time, value)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("x")))
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) for o in (F.asc(time), F.desc(time)))
    # the two anchors at each end are enough to extrapolate; a row never carries its whole series
    ends = {f"_{n}{i}": F.nth_value(point, i, True).over(w) for n, w in (("f", up), ("l", down)) for i in (1, 2)}
    d = dense_periods(anchors, keys, time, first, last).withColumns({"_p": prev, "_n": nxt, **ends})
    p, n, t = F.col("_p"), F.col("_n"), F.col(time)
    x = (
        F.when(F.col("_f1").isNull(), F.lit(None).cast("double"))
        .when(F.col("_f2").isNull(), F.col("_f1")["x"])
        .when(p.isNull(), _between(t, F.col("_f1"), F.col("_f2")))
        .when(n.isNull(), _between(t, F.col("_l2"), F.col("_l1")))
        .when(p["t"] == n["t"], p["x"])
        .otherwise(_between(t, p, n))
    )
    return d.select(*keys, time, x.alias(value))


def sort_bands(df: DataFrame, keys: Sequence[str], band: str, value: str) -> DataFrame:
    """Bands of each cell-year in ascending value order (quantiles must not cross)."""
    arrays = df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    return arrays.select(*keys, F.posexplode("_v").alias(band, value)).withColumn(band, F.col(band) + 1)


def bio_year(year: Column, month: Column) -> Column:
    """August opens the next bio-year."""
    return year + (month >= 8).cast("int")


def complete_bio_years(df: DataFrame, layers_per_year: int, var: str | None = None) -> DataFrame:
    """Rows of bio-years whose monthly layers are all in the data set."""
    dated = df.withColumn("bio_year", bio_year(F.col("year"), F.col("month")))
    layer = ["bio_year", "month", *([var] if var else [])]
    complete = dated.select(*layer).distinct().groupBy("bio_year").agg(F.count("*").alias("_n")).where(F.col("_n") == layers_per_year)
    # one row a year of the calendar; a shuffle would leave each bio-year's rows to one task
    return dated.join(F.broadcast(complete), "bio_year", "left_semi")


def ema(df: DataFrame, keys: Sequence[str], time: str, value: str, alpha: float = EMA_ALPHA, nan_policy: str = "hold") -> DataFrame:
    """Exponentially smoothed state per key and period, in period order.

    The first value seeds the state; a missing value holds it (or, with
    ``nan_policy='reference'``, makes it missing for ever). Expects one row per key and period.
    """
    seq = F.array_sort(F.collect_list(F.struct(F.col(time).cast("bigint").alias("t"), F.col(value).cast("double").alias("x"))))

    @F.pandas_udf("array<double>")
    def fold(series: pd.Series) -> pd.Series:
        out: list = []
        longest = max((len(x) for x in series), default=0)
        step = max(1, (1 << 21) // max(longest, 1))
        for start in range(0, len(series), step):
            part = [np.asarray(x, dtype=float) for x in series.iloc[start:start + step]]
            out.extend(_fold_rows(part, alpha, nan_policy == "hold"))
        return pd.Series(out, dtype=object)

    series = df.groupBy(*keys).agg(seq.alias("_seq"))
    folded = series.withColumn("_s", fold(F.transform("_seq", lambda p: p["x"])))
    pairs = F.explode(F.zip_with("_seq", "_s", lambda p, s: F.struct(p["t"].alias("t"), F.nanvl(s, F.lit(None).cast("double")).alias("s"))))
    return folded.select(*keys, pairs.alias("_e")).select(*keys, F.col("_e.t").alias(time), F.col("_e.s").alias("state"))


def _fold_rows(rows: list[np.ndarray], alpha: float, hold: bool) -> list[np.ndarray]:
    """States of many series at once, period by period; NaN is a missing value."""
    x = np.full((len(rows), max((len(r) for r in rows), default=0)), np.nan)
    for i, r in enumerate(rows):
        x[i, :len(r)] = r
    level, dead = np.full(len(rows), np.nan), np.zeros(len(rows), dtype=bool)
    for t in range(x.shape[1]):
        now = x[:, t]
        missing = np.isnan(now)
        level = np.where(missing, level, np.where(np.isnan(level), now, alpha * now + (1 - alpha) * level))
        if not hold:
            dead |= missing
        x[:, t] = np.where(dead, np.nan, level)
    return [x[i, :len(r)] for i, r in enumerate(rows)]


def circular_smooth(df: DataFrame, keys: Sequence[str], period: str, value: str, sigma: float, n_periods: int = 52, clip: bool = True) -> DataFrame:
    """Gaussian smoothing round the year; absent periods count 0 and stay absent in the result.

    One aggregate per target period: a row adds to ``n_periods`` sums of its key in place,
    nothing is exploded before the shuffle.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    ring = [0.0] * n_periods
    for d, w in zip(range(-r, r + 1), weights):
        ring[d % n_periods] += w
    table = F.array(*[F.lit(w) for w in ring])
    lag = [F.get(table, F.pmod(F.lit(t) - F.col(period), F.lit(n_periods)).cast("int")) for t in range(n_periods)]
    wide = df.groupBy(*keys).agg(F.array(*[F.sum(w * F.col(value)) for w in lag]).alias("_v"))
    out = wide.select(*keys, F.posexplode("_v").alias(period, value)).where(F.col(value) != 0.0)
    return out.withColumn(value, F.greatest(value, F.lit(0.0))) if clip else out


def hellinger(df: DataFrame, cell: str, value: str, floor: float = 1e-9) -> DataFrame:
    """sqrt(x / row sum); a row without mass is divided by 1."""
    total = df.groupBy(cell).agg(F.sum(value).alias("_t"))
    scale = F.when(F.col("_t") < floor, 1.0).otherwise(F.col("_t"))
    return df.join(total, cell).withColumn(value, F.sqrt(F.col(value) / scale)).drop("_t")


def pooled_frames(df: DataFrame, keys: Sequence[str], time: str, radius: int, sums: Sequence[str]) -> DataFrame:
    """Sums over +/- radius periods around each centre period, mirrored and clamped at the ends."""
    totals = df.groupBy(*keys, time).agg(*[F.sum(c).alias(c) for c in sums])
    t = F.col("_c") + F.col("_o")
    mirrored = F.when(t < F.col("_lo"), 2 * F.col("_lo") - t).when(t > F.col("_hi"), 2 * F.col("_hi") - t).otherwise(t)
    frames = (
        df.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
        .withColumn("_c", F.explode(F.sequence("_lo", "_hi")))
        .withColumn("_o", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
        .select(F.col("_c").alias("frame"), F.least("_hi", F.greatest("_lo", mirrored)).alias(time))
        .groupBy("frame", time).agg(F.count("*").alias("_k"))
    )
    return totals.join(frames, time).groupBy(*keys, "frame").agg(*[F.sum(F.col(c) * F.col("_k")).alias(c) for c in sums])


def lockstep(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of two yearly tables at the same (cell, year)."""
    return a.join(b, list(keys))


def alignment(a: DataFrame, b: DataFrame, keys: Sequence[str], a_name: str, b_name: str) -> DataFrame:
    """One row: keys in both tables and in only one of them."""
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sides = tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.agg(
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("matched"),
        F.count_if(F.col("_b") == 0).alias(f"only_{a_name}"),
        F.count_if(F.col("_a") == 0).alias(f"only_{b_name}"),
    )


def last_wins(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def endpoint_change(df: DataFrame, keys: Sequence[str], time: str, value: str, first: int, last: Column | int) -> DataFrame:
    """Difference between two periods for keys that have both."""
    end = last if isinstance(last, Column) else F.lit(last)
    a = F.max(F.when(F.col(time) == first, F.col(value)))
    b = F.max(F.when(F.col(time) == F.col("_end"), F.col(value)))
    both = df.withColumn("_end", end).where((F.col(time) == first) | (F.col(time) == F.col("_end"))).groupBy(*keys).agg(a.alias("_a"), b.alias("_b"))
    return both.where("_a IS NOT NULL AND _b IS NOT NULL").select(*keys, (F.col("_b") - F.col("_a")).alias("delta"))


def latest_available(df: DataFrame, time: str, wanted: int) -> Column:
    """``wanted`` if the data has it, else the last period."""
    return df.agg(F.coalesce(F.max(F.when(F.col(time) == wanted, F.col(time))), F.max(time)).alias("t")).scalar()


def epoch_means(df: DataFrame, keys: Sequence[str], time: str, value: str, epochs: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean per key in each named period range, one pass."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(time).between(lo, hi), F.col(value))).alias(n) for n, (lo, hi) in epochs.items()])


def period_anomaly(df: DataFrame, time: str, value: str) -> DataFrame:
    """x minus the mean of its period. The means are aggregated and joined back, so a period
    with a third of the rows needs no single-task window."""
    means = df.groupBy(time).agg(F.avg(value).alias("_m"))
    return df.join(means, time).withColumn("anomaly", F.col(value) - F.col("_m")).drop("_m")
