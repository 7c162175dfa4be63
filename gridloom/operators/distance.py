"""Nearest source cell by an exact separable distance transform.

The nearest source of a cell lies in some row; within a row it is the nearest source to the left or to the right. So columns are
dealt in strips of ``STRIP``: a strip gets, of every row that has sources, those inside the strip and the next one on
either side. In a strip a first pass names the nearest source column of each row for each column; a second one walks from each target
up and down over the rows that have sources, as long as the row alone is not farther than the best source so far. No list of
candidates leaves a task, and there is one shuffle of rows, however far the sources are.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIP = 32
#: Targets that walk together.
TOGETHER = 1 << 18
_NONE = np.iinfo(np.int64).min


def row_nearest(inside: list, left: np.ndarray, right: np.ndarray, first: int, width: int = STRIP) -> np.ndarray:
    """(rows x width): nearest source column in each row for each column of a strip, the smaller of two. ``left`` and ``right`` are the
    next sources outside (``_NONE``: none); every row has at least one source."""
    rows = len(inside)
    column = first + np.arange(width)
    before, after = np.full((rows, width), _NONE), np.full((rows, width), _NONE)
    sizes = np.array([len(x) for x in inside])
    at = np.concatenate([np.asarray(x, np.int64) for x in inside]) if sizes.sum() else np.zeros(0, np.int64)
    own = np.repeat(np.arange(rows), sizes)
    before[own, at - first] = after[own, at - first] = at
    before[:, 0] = np.where(before[:, 0] == _NONE, left, before[:, 0])
    after[:, -1] = np.where(after[:, -1] == _NONE, right, after[:, -1])
    before = np.maximum.accumulate(before, 1)
    for k in range(width - 2, -1, -1):
        after[:, k] = np.where(after[:, k] == _NONE, after[:, k + 1], after[:, k])
    take = (after == _NONE) | ((before != _NONE) & (column - before <= after - column))
    return np.where(take, before, after)


def _walk(t: np.ndarray, rows: np.ndarray, nearest: np.ndarray, first: int) -> np.ndarray:
    """(source row, source col, squared distance) of each target, ties by (row, col)."""
    best = np.full((len(t), 3), np.iinfo(np.int64).max)
    start = np.searchsorted(rows, t[:, 0])
    for step, where in ((-1, start - 1), (1, start)):
        live, at = np.arange(len(t)), where.copy()
        while True:
            ok = (at >= 0) & (at < len(rows))
            live, at = live[ok], at[ok]
            gap = rows[at] - t[live, 0]
            ok = gap * gap <= best[live, 2]
            live, at, gap = live[ok], at[ok], gap[ok]
            if not len(live):
                break
            col = nearest[at, t[live, 1] - first]
            d = gap * gap + (col - t[live, 1]) ** 2
            old = best[live]
            better = (d < old[:, 2]) | ((d == old[:, 2]) & ((rows[at] < old[:, 0]) | ((rows[at] == old[:, 0]) & (col < old[:, 1]))))
            best[live[better]] = np.c_[rows[at], col, d][better]
            at = at + step
    return best


def _strip(layers: Sequence[str]):
    """The function of one strip's key and rows."""

    def solve(key, pdf):
        first = int(key[-1]) * STRIP
        asks = pdf["_cols"].isna()
        t = pdf.loc[asks, ["row", "col"]].to_numpy(np.int64)
        source = pdf[~asks].sort_values("row")
        out = np.zeros((0, 3), np.int64)
        if len(source):
            ends = [source[c].fillna(_NONE).to_numpy(np.int64) for c in ("_left", "_right")] if source[["_left", "_right"]].notna().any(axis=None) else [np.full(len(source), _NONE)] * 2
            near = row_nearest(source["_cols"].tolist(), *ends, first)
            rows = source["row"].to_numpy(np.int64)
            out = np.concatenate([out, *[_walk(t[a:a + TOGETHER], rows, near, first) for a in range(0, len(t), TOGETHER)]])
        done = pd.DataFrame(np.c_[t[:len(out)], out], columns=["row", "col", "n_row", "n_col", "d2"])
        for i, name in enumerate(layers):
            done.insert(i, name, pd.Series([key[i]] * len(done), dtype=object))
        return done

    return solve


def nearest_source(targets: DataFrame, sources: DataFrame, layers: Sequence[str] = ()) -> DataFrame:
    """(layers, row, col, n_row, n_col, d): the nearest source cell of each target cell of the same layer, ties by (row, col).

    Targets of a layer without sources give no row; repeated cells count once, and cells without coordinates are left out. A task holds
    one strip of one layer: ``STRIP`` columns of all rows that have sources.
    """
    layers = list(layers)
    kinds = {c: sources.schema[c].dataType for c in ("row", "col")}
    where = "row IS NOT NULL AND col IS NOT NULL"
    at = [*layers, *[F.col(c).cast("long").alias(c) for c in ("row", "col")]]
    strip = F.floor(F.col("col") / STRIP).alias("_strip")
    asked = targets.where(where).select(*at).distinct().select("*", strip)
    rows = sources.where(where).select(*at).groupBy(*layers, "row").agg(F.sort_array(F.collect_set("col")).alias("_all"))
    strips = asked.select(*layers, "_strip").distinct()
    strips = strips.groupBy(*layers).agg(F.collect_list("_strip").alias("_strips")) if layers else strips.agg(F.collect_list("_strip").alias("_strips"))
    met = rows.join(strips, layers) if layers else rows.withColumn("_strips", strips.scalar())
    low = F.col("_strip") * STRIP
    cut = met.select(*layers, "row", "_all", F.explode("_strips").alias("_strip")).select(
        *layers, "row", F.lit(None).cast("long").alias("col"), "_strip", F.filter("_all", lambda c: (c >= low) & (c < low + STRIP)).alias("_cols"),
        F.array_max(F.filter("_all", lambda c: c < low)).alias("_left"), F.array_min(F.filter("_all", lambda c: c >= low + STRIP)).alias("_right"))
    none = [F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in ("_cols", "_left", "_right")]
    schema = ", ".join([*[f"`{c}` {sources.schema[c].dataType.simpleString()}" for c in layers], "row long, col long, n_row long, n_col long, d2 long"])
    found = asked.select(*layers, "row", "col", "_strip", *none).unionByName(cut).groupBy(*layers, "_strip").applyInPandas(_strip(layers), schema)
    return found.select(*layers, *[F.col(c).cast(kinds[c[-3:]]).alias(c) for c in ("row", "col", "n_row", "n_col")], F.sqrt("d2").alias("d"))
