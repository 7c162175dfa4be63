"""Hulls, distances, nearest neighbours, gap filling."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.distance import nearest_source
from gridloom.operators.focal import apply_kernels, inverse_distance
from gridloom.session import durable

# -- convex hull -----------------------------------------------------------------


def hull_vertices(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of (n, 2) points, collinear points left out."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(ordered) -> list:
        out: list = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(pts), chain(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


def _hull_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hull = np.empty((0, 2))
    for pdf in batches:
        hull = hull_vertices(np.vstack([hull, pdf[["x", "y"]].to_numpy(float)]))
    yield pd.DataFrame({"ord": np.arange(len(hull), dtype="int32"), "x": hull[:, 0] if len(hull) else [], "y": hull[:, 1] if len(hull) else []})


def convex_hull(points: DataFrame, x: str, y: str, fan_in: int | None = None) -> DataFrame:
    """(ord, x, y) of the hull, counter-clockwise.

    Only the extremes of each y can be vertices, so they are cut out before Python sees the
    points. Hulls are merged per task, then over ``fan_in`` tasks, then once more: each
    stage passes on vertices only.
    """
    fan_in = fan_in or min(64, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pts = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    extremes = pts.groupBy("y").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select(F.explode(F.array("lo", "hi")).alias("x"), "y")
    schema = "ord INT, x DOUBLE, y DOUBLE"
    per_task = extremes.mapInPandas(_hull_of_batches, schema)
    merged = per_task.repartition(fan_in).mapInPandas(_hull_of_batches, schema)
    return merged.repartition(1).mapInPandas(_hull_of_batches, schema)


def with_ring(df: DataFrame, hull: DataFrame) -> DataFrame:
    """Attach the closed hull ring as one array column (hull vertices only, a scalar subquery)."""
    ring = hull.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("r"))
    closed = ring.select(F.concat("r", F.slice("r", 1, 1)).alias("r"))
    return df.withColumn("_ring", closed.scalar())


def _edges(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    a, b = F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n)
    return F.zip_with(a, b, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def _to_edge(px: Column, py: Column):
    """Distance from a point to an edge, which may be a single point."""

    def distance(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length = dx * dx + dy * dy
        t = F.coalesce(F.try_divide((px - e["x1"]) * dx + (py - e["y1"]) * dy, length), F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        return F.sqrt(F.pow(px - e["x1"] - t * dx, 2) + F.pow(py - e["y1"] - t * dy, 2))

    return distance


def _holds(ring: Column, edges: Column, x: str, y: str) -> Column:
    """Whether the hull with this ring holds the point."""
    px, py = F.col(x), F.col(y)
    side = lambda e: (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"]) >= 0
    flat = F.coalesce(F.array_min(F.transform(edges, _to_edge(px, py))) <= 1e-9, F.lit(False))
    return F.when(F.size(ring) > 3, F.forall(edges, side)).otherwise(flat)


def inside_hull(cells: DataFrame, hull: DataFrame, x: str, y: str) -> DataFrame:
    """Add ``inside``: the point lies in the hull or on its edge. A hull of one or two points holds only
    what lies on it, an empty one nothing."""
    return with_ring(cells, hull).withColumn("inside", _holds(F.col("_ring"), _edges(F.col("_ring")), x, y)).drop("_ring")


def distance_to_hull(cells: DataFrame, hull: DataFrame, x: str, y: str) -> DataFrame:
    """Add ``distance``: 0 inside, else the exact distance to the nearest hull edge; missing for an empty hull."""
    ring, edges = F.col("_ring"), _edges(F.col("_ring"))
    nearest = F.array_min(F.transform(edges, _to_edge(F.col(x), F.col(y))))
    return with_ring(cells, hull).withColumn("distance", F.when(_holds(ring, edges, x, y), 0.0).otherwise(nearest)).drop("_ring")


def core_margin(cells: DataFrame, margin: DataFrame, core: DataFrame, x: str, y: str, core_density: float = 0.1, margin_density: float = 0.001) -> DataFrame:
    """Initial density: the margin hull is thin, the core hull overwrites it, elsewhere 0."""
    a = inside_hull(cells, margin, x, y).withColumnRenamed("inside", "_m")
    b = inside_hull(a, core, x, y)
    return b.withColumn("density", F.when(F.col("inside"), core_density).when(F.col("_m"), margin_density).otherwise(0.0)).drop("_m", "inside")


# -- nearest neighbours ------------------------------------------------------------


#: Children of a bucket along each axis.
FAN = 4
#: Tiles of the first pass, and how far it looks around a target.
TILE, HALO = 64, 16
#: Most neighbours the first pass lists.
NEAR = 64


def _in_tile(layers: Sequence[str], k: int):
    """The function of one tile's key and rows: for each target the codes of its k nearest sources within ``HALO``, in order;
    -1 at the end where there are fewer."""
    span = range(-HALO, HALO + 1)
    steps = sorted((dr * dr + dc * dc, dr, dc) for dr in span for dc in span if dr * dr + dc * dc <= HALO * HALO)

    def solve(key, pdf):
        cells = pdf[["row", "col"]].to_numpy(np.int64)
        at, asks = cells - np.array([int(key[-2]), int(key[-1])]) * TILE + HALO, pdf["_asks"].to_numpy(bool)
        seen = np.zeros((TILE + 2 * HALO, TILE + 2 * HALO), bool)
        seen[tuple(at[~asks].T)] = True
        t = at[asks]
        codes, n, live = np.full((len(t), k), -1), np.zeros(len(t), int), np.arange(len(t))
        for _, dr, dc in steps:
            if not len(live):
                break
            hit = live[seen[t[live, 0] + dr, t[live, 1] + dc]]
            if len(hit):
                codes[hit, n[hit]] = (dr + HALO) * len(span) + dc + HALO
                n[hit] += 1
                live = live[n[live] < k]
        out = pd.DataFrame(np.c_[cells[asks], codes], columns=["row", "col", *[f"_n{i}" for i in range(k)]])
        for i, name in enumerate(layers):
            out.insert(i, name, pd.Series([key[i]] * len(out), dtype=object))
        return out

    return solve


def _near_in_tiles(targets: DataFrame, sources: DataFrame, k: int, layers: Sequence[str]) -> DataFrame:
    """(layers, row, col, _n0 .. _n{k-1}): the first pass over tiles with a halo, one row per target."""
    at = [*layers, *[F.col(c).cast("long").alias(c) for c in ("row", "col")]]

    def deal(df: DataFrame, asks: bool, reach: int) -> DataFrame:
        span = [F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE))).alias(f"_t{c}") for c in ("row", "col")]
        return df.select(*at).select("*", span[0]).select("*", span[1]).withColumn("_asks", F.lit(asks))

    rows = deal(targets, True, 0).unionByName(deal(sources, False, HALO))
    schema = [*[f"`{c}` {targets.schema[c].dataType.simpleString()}" for c in layers], "row long, col long", *[f"_n{i} int" for i in range(k)]]
    return rows.groupBy(*layers, "_trow", "_tcol").applyInPandas(_in_tile(layers, k), ", ".join(schema))


def nearest(targets: DataFrame, sources: DataFrame, k: int, payload: Sequence[str] = (), layers: Sequence[str] = ()) -> DataFrame:
    """Exact k nearest source cells of each target cell of the same layer, ties by (row, col).

    A first pass over tiles settles every target with k sources within ``HALO`` cells: no source outside can be as
    near. For the others, sources are counted in a pyramid of square buckets. From the top down, a target keeps the
    buckets that can hold one of its k nearest: the counts give an upper bound of the k-th
    distance, and buckets wholly beyond it go. The list grows with k and with the arc of
    buckets at about that distance, never with the area, however far the sources are.
    Output: (layers, row, col, n_row, n_col, d, rank, payload); fewer than k rows where a layer has
    fewer sources. Of repeated source cells the smallest payload counts; cells without coordinates have no
    neighbours and are none.
    """
    layers, payload = list(layers), list(payload)
    one = [F.min(F.struct(*payload)).alias("_pay")] if payload else [F.count("*").alias("_pay")]
    src = durable(sources.where("row IS NOT NULL AND col IS NOT NULL").groupBy(*layers, "row", "col").agg(*one))
    near, found = targets.select(*layers, "row", "col").distinct(), None
    if k <= NEAR:
        # a layer without a name has no neighbours
        whole = " AND ".join(f"`{c}` IS NOT NULL" for c in [*layers, "row", "col"])
        first = durable(_near_in_tiles(near.where(whole), src.where(whole), k, layers))
        code, wide = F.col("_code"), 2 * HALO + 1
        dr, dc = F.floor(code / wide) - HALO, code % wide - HALO
        settled = first.where(F.col(f"_n{k - 1}") >= 0).select(*layers, "row", "col", F.posexplode(F.array(*[f"_n{i}" for i in range(k)])).alias("_at", "_code"))
        found = _named(settled.select(*layers, "row", "col", "_at", (F.col("row") + dr).alias("r"), (F.col("col") + dc).alias("c"), (dr * dr + dc * dc).cast("double").alias("d2")), targets, sources, layers)
        near = first.where(F.col(f"_n{k - 1}") < 0).select(*layers, *[F.col(c).cast(targets.schema[c].dataType).alias(c) for c in ("row", "col")])
    if found is None or not near.isEmpty():
        far = _named(_descend(near, src, k, layers), targets, sources, layers)
        found = far if found is None else found.unionByName(far)
    if not payload:
        return found
    carried = src.select(*layers, F.col("row").alias("n_row"), F.col("col").alias("n_col"), "_pay.*")
    return found.join(carried, [*layers, "n_row", "n_col"]).select(*found.columns, *payload)


def _named(rows: DataFrame, targets: DataFrame, sources: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Rows of target, place in its list (_at), source (r, c) and squared distance as the columns of ``nearest``."""
    own = [F.col(c).cast(targets.schema[c].dataType).alias(c) for c in ("row", "col")]
    other = [F.col(c[0]).cast(sources.schema[c].dataType).alias(f"n_{c}") for c in ("row", "col")]
    return rows.select(*layers, *own, *other, F.sqrt("d2").alias("d"), (F.col("_at") + 1).alias("rank"))


def _descend(near: DataFrame, src: DataFrame, k: int, layers: Sequence[str]) -> DataFrame:
    """(layers, row, col, _at, r, c, d2): the k nearest sources of targets by a pyramid of bucket counts."""
    box = src.agg(F.min("row").alias("r"), F.min("col").alias("c"), F.greatest(F.max("row") - F.min("row"), F.max("col") - F.min("col")).alias("span")).first()
    r0, c0, depth = box["r"] or 0, box["c"] or 0, 1
    while FAN**depth <= (box["span"] or 0):
        depth += 1
    near = near.withColumn("_c", F.expr("array(named_struct('lo', 0D, 'r', 0L, 'c', 0L))")).withColumn("_hi", F.lit(math.inf))
    for level in reversed(range(depth)):
        size = FAN**level
        buckets = src.groupBy(*layers, F.floor((F.col("row") - r0) / size).alias("r"), F.floor((F.col("col") - c0) / size).alias("c")).agg(F.count("*").alias("n"))
        parents = buckets.groupBy(*layers, F.floor(F.col("r") / FAN).alias("_r"), F.floor(F.col("c") / FAN).alias("_c")).agg(F.collect_list(F.struct("r", "c", "n")).alias("_kids"))
        asked = near.withColumn("_p", F.explode("_c")).where("_p.lo <= _hi").select(*layers, "row", "col", "_hi", F.col("_p.r").alias("_r"), F.col("_p.c").alias("_c"))
        # every bucket is asked for at most once per target and answers with at most FAN^2 children
        met = asked.join(parents, [*layers, "_r", "_c"]).select(*layers, "row", "col", "_hi", F.inline("_kids"))
        near = _with_bound(met, k, size, r0, c0, layers)
    best = F.posexplode(F.slice(F.sort_array(F.transform("_c", lambda b: F.struct(b["lo"].alias("d2"), (b["r"] + r0).alias("r"), (b["c"] + c0).alias("c")))), 1, k))
    return near.select(*layers, "row", "col", best.alias("_at", "_b")).select(*layers, "row", "col", "_at", "_b.r", "_b.c", "_b.d2")


def _with_bound(met: DataFrame, k: int, size: int, r0: int, c0: int, layers: Sequence[str]) -> DataFrame:
    """(layers, row, col, _c, _hi) from rows of target and bucket (r, c, n): the buckets within the bound so far with their
    squared least and greatest distance, and the new bound, the smallest one known to cover k sources."""

    def span(at: str, index: str, origin: int) -> tuple[Column, Column]:
        first = F.col(index) * size + origin - F.col(at)
        last = first + size - 1
        gap = F.greatest(first, -last, F.lit(0)).cast("double")
        return gap, F.greatest(F.abs(first), F.abs(last)).cast("double")

    (lo_r, hi_r), (lo_c, hi_c) = span("row", "r", r0), span("col", "c", c0)
    rows = met.withColumns({"lo": lo_r * lo_r + lo_c * lo_c, "hi": hi_r * hi_r + hi_c * hi_c}).where("lo <= _hi")
    lists = rows.groupBy(*layers, "row", "col")
    if k == 1:  # one source is covered by the least greatest distance
        return lists.agg(F.collect_list(F.struct("lo", "r", "c")).alias("_c"), F.min("hi").alias("_hi"))
    sized = lists.agg(F.collect_list(F.struct("lo", "r", "c")).alias("_c"), F.sort_array(F.collect_list(F.struct("hi", "n"))).alias("_n"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("hi"))

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        return F.struct(n.alias("n"), F.when(a["hi"].isNull() & (n >= k), b["hi"]).otherwise(a["hi"]).alias("hi"))

    return sized.withColumn("_hi", F.coalesce(F.aggregate("_n", start, add)["hi"], F.lit(math.inf))).drop("_n")


def neighbour_weights(neighbours: DataFrame, layers: Sequence[str] = ()) -> DataFrame:
    """Add ``w``: inverse distance, summing to 1 per target."""
    raw = F.lit(1.0) / F.greatest("d", F.lit(1e-6))
    return neighbours.withColumn("w", raw / F.sum(raw).over(Window.partitionBy(*layers, "row", "col")))


# -- gap filling -------------------------------------------------------------------


# Every step takes ``layers``: cells are then filled from cells of their own layer, and ``land`` or the
# field lists the cells of every layer.


def _known(values: Sequence[str]) -> Column:
    whole = F.lit(True)
    for v in values:
        whole = whole & F.col(v).isNotNull()
    return whole


def fill_radius(field: DataFrame, land: DataFrame, values: Sequence[str], radius: float, layers: Sequence[str] = ()) -> DataFrame:
    """Missing land cells within ``radius`` of a valid cell get the inverse-distance mean of the
    valid cells within that radius. Output keeps one row per (layer and) land cell."""
    at = [*layers, "row", "col"]
    valid = land.join(field.where(_known(values)), at)
    sums = apply_kernels(valid.withColumn("_one", F.lit(1.0)), {"idw": inverse_distance(radius)}, [*values, "_one"], layers).drop("kernel")
    reach = sums.where(F.col("_one") > 1e-6).select(*at, *[(F.col(v) / F.col("_one")).alias(f"_f_{v}") for v in values])
    joined = land.join(valid, at, "left").join(reach, at, "left")
    return joined.select(*at, *[F.coalesce(v, f"_f_{v}").alias(v) for v in values])


def fill_static(field: DataFrame, reference: DataFrame, values: Sequence[str], layers: Sequence[str] = ()) -> DataFrame:
    """Remaining gaps take the reference layer, the same one for all layers."""
    ref = reference.select("row", "col", *[F.col(v).alias(f"_r_{v}") for v in values])
    return field.join(ref, ["row", "col"], "left").select(*layers, "row", "col", *[F.coalesce(v, f"_r_{v}").alias(v) for v in values])


def fill_nearest(field: DataFrame, values: Sequence[str], layers: Sequence[str] = ()) -> DataFrame:
    """Whatever is still missing takes the nearest valid cell; without any valid cell it stays missing. Of repeated
    valid cells the smallest values count."""
    at = [*layers, "row", "col"]
    field = durable(field.select(*at, *values))
    gaps, valid = field.where(~_known(values)).select(*at), field.where(_known(values))
    near = nearest_source(gaps, valid, layers)
    one = valid.groupBy(*at).agg(F.min(F.struct(*values)).alias("_v"))
    carried = one.select(*layers, F.col("row").alias("n_row"), F.col("col").alias("n_col"), "_v.*")
    found = near.join(carried, [*layers, "n_row", "n_col"]).select(*at, *values)
    return valid.unionByName(gaps.join(found, at, "left"))
