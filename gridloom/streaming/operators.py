"""Streaming operators: DataFrame in, DataFrame out, for streams with an event-time column."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.clean import replace_sentinels
from gridloom.operators.temporal import EMA_ALPHA


def rollup(stream: DataFrame, time: str, period: str, delay: str, keys: Sequence[str], aggs: Sequence[Column], slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) aggregation per key; a window is emitted once the watermark closes it."""
    window = F.window(time, period, slide) if slide else F.window(time, period)
    return stream.withWatermark(time, delay).groupBy(window.alias("w"), *keys).agg(*aggs)


def ema_state(periods: DataFrame, key: str, time: str, value: str, alpha: float = EMA_ALPHA) -> DataFrame:
    """Exponential state per key over arriving periods: (key, time, state, late).

    One small state per key. A missing value holds the state. Periods at or before the last
    folded one are not folded again; ``late`` counts them so far. The input has one row per key
    and period, so a key brings at most the periods of the micro-batch.
    """
    key_type = periods.schema[key].dataType.simpleString()

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, last, late = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        for t, x in zip(rows[time], rows[value]):
            if last is not None and t <= last:
                late += 1
                continue
            if x is not None and x == x:
                level = float(x) if level is None else alpha * float(x) + (1 - alpha) * level
            last = int(t)
            out.append((k[0], last, level, late))
        state.update((level, last, late))
        yield pd.DataFrame(out, columns=[key, time, "state", "late"])

    return periods.groupBy(key).applyInPandasWithState(
        fold, f"{key} {key_type}, {time} BIGINT, state DOUBLE, late BIGINT", "level DOUBLE, last BIGINT, late BIGINT", "append", "NoTimeout"
    )


def masked_clean(stream: DataFrame, grid: DataFrame, low: float, metric: str = "range") -> DataFrame:
    """Stream-static join with the land mask, sentinels to missing, range violations observed."""
    land = grid.where("is_ocean = 0").select("row", "col")
    cleaned = replace_sentinels(stream.join(land, ["row", "col"]))
    return cleaned.observe(metric, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value") < low).alias("violations"))


def lockstep(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two windowed roll-ups at the same key and window; both sides carry watermarks."""
    return a.join(b, ["w", *keys], "inner")


def deduplicate(stream: DataFrame, time: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """First arrival per key inside the watermark. Rows behind the watermark of the previous
    micro-batch are dropped and counted in the progress of the state operator."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
