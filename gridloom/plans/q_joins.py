"""Joins: zero-fill, lookups, hulls, neighbours, gap filling."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import ordering, text
from gridloom.operators import focal, rates, spatial, survey, temporal, traits, triangulation
from gridloom.plans.registry import query
from gridloom.plans.views import r6

VISITS = "vis AS (SELECT visit, route, year FROM v_effort WHERE run_type = 1 AND year BETWEEN 1996 AND 2000)"
SMALL = "cnt AS (SELECT visit, n FROM v_counts WHERE species = 'SMALL')"


def visits(v):
    return survey.quality_visits(v.effort(), 1996, 2000).drop("run_type")


def small(v):
    return v.counts().where("species = 'SMALL'").select("visit", "n")


def filled(v):
    return survey.zero_fill_counts(visits(v), small(v), ["visit"])


def fine_cell(df):
    return df.withColumns({"row": F.floor(F.col("route") / 32).cast("int"), "col": F.pmod("route", F.lit(32)).cast("int")})


@query("P10_quality_filter", "SELECT visit, route, year, run_type FROM v_effort WHERE run_type = 1 AND year BETWEEN 1996 AND 2000")
def _(v):
    return survey.quality_visits(v.effort(), 1996, 2000)


@query("P10b_quality_protocol", "SELECT o_orderkey AS visit, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderpriority = '1-URGENT' THEN 102 ELSE 101 END AS rpid FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1993 AND 2000 AND o_orderpriority <> '1-URGENT'")
def _(v):
    protocol = v.table("orders").select(F.col("o_orderkey").alias("visit"), F.when(F.col("o_orderpriority") == "1-URGENT", 102).otherwise(101).alias("rpid"))
    return survey.quality_visits(v.effort().join(protocol, "visit"), 1993, 2000, protocol=101).select("visit", "year", "rpid")


@query("J1_zero_fill", VISITS + ", " + SMALL + " SELECT visit, route, year, coalesce(n, 0) AS n FROM vis LEFT JOIN cnt USING (visit)")
def _(v):
    return filled(v)


@query("J1_zero_fill_coarse_mean", VISITS + ", " + SMALL + """ SELECT CAST(route // 32 // 4 AS INTEGER) AS row, CAST(route % 32 // 4 AS INTEGER) AS col, year,
    count(*) AS visits, avg(coalesce(n, 0)) AS mean_n FROM vis LEFT JOIN cnt USING (visit) GROUP BY ALL""")
def _(v):
    cells = survey.coarsen(fine_cell(filled(v)), 4)
    return cells.groupBy("row", "col", "year").agg(F.count("*").alias("visits"), F.avg("n").alias("mean_n"))


@query("P19_coarsen_index", "SELECT visit, CAST(route // 32 // 4 AS INTEGER) AS row, CAST(route % 32 // 4 AS INTEGER) AS col, year FROM v_effort")
def _(v):
    return survey.coarsen(fine_cell(v.effort()), 4).select("visit", "row", "col", "year")


@query("J2_route_location", VISITS + """ SELECT visit, route, year, -124.0::DOUBLE + (c_custkey % 997) * 0.055::DOUBLE AS lon, 26.0::DOUBLE + (c_custkey % 613) * 0.035::DOUBLE AS lat FROM vis JOIN customer ON c_custkey = route""")
def _(v):
    key = F.col("c_custkey")
    routes = v.table("customer").select(key.alias("route"), (F.lit(-124.0) + F.pmod(key, F.lit(997)) * 0.055).alias("lon"), (F.lit(26.0) + F.pmod(key, F.lit(613)) * 0.035).alias("lat"))
    return visits(v).join(routes, "route")


@query("J3_lookup_fanout", """SELECT s_suppkey, c.code, common FROM (SELECT s_suppkey, lower(n_name) AS code FROM supplier JOIN nation ON n_nationkey = s_nationkey) c
    LEFT JOIN (SELECT code, common FROM v_taxonomy UNION ALL SELECT code, upper(common) FROM v_taxonomy WHERE nk % 4 = 0) t ON t.code = c.code""")
def _(v):
    names = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("code"))
    tax = v.taxonomy()
    wide = tax.select("code", "common").unionByName(tax.where("nk % 4 = 0").select("code", F.upper("common").alias("common")))
    return names.join(wide, "code", "left")


@query("J4_semi_join", "SELECT part, size, price FROM v_traits WHERE part IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50)")
def _(v):
    wanted = v.table("lineitem").where("l_returnflag = 'R' AND l_quantity = 50").select(F.col("l_partkey").alias("part"))
    return v.traits().join(wanted, "part", "left_semi").select("part", "size", "price")


@query("J5_required_member", "SELECT part, size FROM v_traits")
def _(v):
    return traits.require_member(v.traits(), "part", 7).select("part", "size")


@query("J6_dictionary_map", "SELECT user_id, day, x, sci_name FROM v_series JOIN v_taxonomy ON nk = user_id % 40")
def _(v):
    s = v.series().withColumn("nk", F.pmod("user_id", F.lit(40)).cast("int"))
    return s.join(v.taxonomy().select("nk", "sci_name"), "nk").drop("nk")


@query("J7_name_join", """SELECT t.nk, s_suppkey FROM v_taxonomy t JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) s
    ON replace(lower(trim(sci_name)), '_', ' ') = 'genus ' || replace(lower(n_name), '_', ' ')""")
def _(v):
    left = v.taxonomy().select("nk", text.normalize_name(F.col("sci_name")).alias("norm"))
    right = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", text.normalize_name(F.concat(F.lit("GENUS_"), "n_name")).alias("norm"))
    return left.join(right, "norm").drop("norm")


@query("J8_first_wins", """SELECT key, target, ord FROM (SELECT o_custkey AS key, o_orderpriority AS target, o_orderkey AS ord,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1""")
def _(v):
    cw = v.table("orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("target"), F.col("o_orderkey").alias("ord"))
    return traits.crosswalk(cw, "key", "target", "ord")


@query("J9_sites_by_years", "SELECT row, col, CAST(y AS INTEGER) AS year, 0::BIGINT AS n FROM v_land, range(1995, 2002) AS g(y)")
def _(v):
    return survey.pseudo_zeros(v.land(), 1995, 2001)


def hull_sql(points: str, edges: str) -> str:
    """Counter-clockwise hull edges by definition: every point is left of, or on, the edge."""
    return f"""ex_{edges} AS (SELECT row AS y, unnest([min(col), max(col)]) AS x FROM {points} GROUP BY row),
    {edges} AS (SELECT DISTINCT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ex_{edges} a, ex_{edges} b WHERE (a.x <> b.x OR a.y <> b.y)
        AND NOT EXISTS (SELECT 1 FROM ex_{edges} p WHERE (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) < 0
            OR ((b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) AND ((p.x - a.x) * (p.x - b.x) > 0 OR (p.y - a.y) * (p.y - b.y) > 0))))"""


NATIVE = """pts AS (SELECT CAST(route // 32 AS INTEGER) AS row, CAST(route % 32 AS INTEGER) AS col, max(n) AS n FROM v_effort JOIN v_counts USING (visit)
    WHERE species = 'SMALL' AND year <= 1997 AND n > 0 AND route % 32 < 21 GROUP BY ALL), """ + hull_sql("pts", "ed")


def native_points(v):
    seen = fine_cell(v.effort().join(v.counts().where("species = 'SMALL'"), "visit"))
    return survey.native_range(seen, last_year=1997, ncols=32).groupBy("row", "col").agg(F.max("n").alias("n"))


@query("J11_convex_hull", NATIVE + " SELECT CAST(x1 AS DOUBLE) AS x, CAST(y1 AS DOUBLE) AS y FROM ed")
def _(v):
    return spatial.convex_hull(native_points(v), "col", "row").select("x", "y")


@query("J12_point_in_hull", NATIVE + """ SELECT row, col FROM v_land WHERE NOT EXISTS (SELECT 1 FROM ed WHERE (x2 - x1) * (row - y1) - (y2 - y1) * (col - x1) < 0)""")
def _(v):
    hull = spatial.convex_hull(native_points(v), "col", "row")
    return spatial.inside_hull(v.land(), hull, "col", "row").where("inside").select("row", "col")


DIST = NATIVE + """, tt AS (SELECT l.row, l.col, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, least(1.0, greatest(0.0, ((l.col - x1) * (x2 - x1) + (l.row - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE)) AS t,
        (x2 - x1) * (l.row - y1) - (y2 - y1) * (l.col - x1) AS side FROM v_land l, ed),
    ds AS (SELECT row, col, CASE WHEN min(side) >= 0 THEN 0 ELSE min(sqrt(pow(col - x1 - t * dx, 2) + pow(row - y1 - t * dy, 2))) END AS distance FROM tt GROUP BY row, col)"""


@query("J13_distance_within", DIST + " SELECT row, col, R6(distance) AS distance FROM ds WHERE distance <= 6.25")
def _(v):
    hull = spatial.convex_hull(native_points(v), "col", "row")
    near = spatial.distance_to_hull(v.land(), hull, "col", "row").where("distance <= 6.25")
    return near.select("row", "col", r6(F.col("distance")).alias("distance"))


@query("J10_uninvaded_cells", DIST + " SELECT row, col FROM ds WHERE distance > 6.25")
def _(v):
    hull = spatial.convex_hull(native_points(v), "col", "row")
    near = spatial.distance_to_hull(v.land(), hull, "col", "row").where("distance <= 6.25").select("row", "col")
    return v.land().join(near, ["row", "col"], "left_anti")


CORE = NATIVE + ", cpts AS (SELECT * FROM pts WHERE n > (SELECT quantile_cont(n, 0.75) FROM pts)), " + hull_sql("cpts", "ec")


@query("P48_core_margin_density", CORE + """ SELECT row, col, CASE WHEN NOT EXISTS (SELECT 1 FROM ec WHERE (x2 - x1) * (row - y1) - (y2 - y1) * (col - x1) < 0) THEN 0.1::DOUBLE
    WHEN NOT EXISTS (SELECT 1 FROM ed WHERE (x2 - x1) * (row - y1) - (y2 - y1) * (col - x1) < 0) THEN 0.001::DOUBLE ELSE 0 END AS density FROM v_land""")
def _(v):
    points = native_points(v)
    limit = ordering.exact_quantiles(points, "n", [0.75], ["q"]).scalar()
    core = spatial.convex_hull(points.withColumn("_q", limit).where("n > _q"), "col", "row")
    return spatial.core_margin(v.land(), spatial.convex_hull(points, "col", "row"), core, "col", "row")


KNN = """pr AS (SELECT o.row, o.col, l.row AS n_row, l.col AS n_col, pow(o.row - l.row, 2) + pow(o.col - l.col, 2) AS d2 FROM v_grid o JOIN v_land l ON abs(o.row - l.row) <= 12 AND abs(o.col - l.col) <= 12 WHERE o.is_ocean = 1),
    kk AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, n_row, n_col) AS rank FROM pr), w AS (SELECT *, 1 / greatest(sqrt(d2), 1e-6) AS raw FROM kk WHERE rank <= 20)"""


@query("J14_nearest_land", KNN + " SELECT row, col, n_row, n_col, CAST(rank AS INTEGER) AS rank, R6(raw / sum(raw) OVER (PARTITION BY row, col)) AS w FROM w")
def _(v):
    ocean = v.grid().where("is_ocean = 1").select("row", "col")
    near = spatial.neighbour_weights(spatial.nearest(ocean, v.land(), 20))
    return near.select("row", "col", "n_row", "n_col", "rank", r6(F.col("w")).alias("w"))


def sparse_field(v):
    """Values above 25 count as missing: gaps all over the grid."""
    return v.land_field().where("v <= 25")


SPARSE = """sf AS (SELECT row, col, v FROM v_land_field WHERE v <= 25)"""
IDW = SPARSE + """, tg AS (SELECT row, col FROM v_land ANTI JOIN sf USING (row, col)),
    iw AS (SELECT tg.row, tg.col, sum(sf.v / sqrt(pow(tg.row - sf.row, 2) + pow(tg.col - sf.col, 2))) / sum(1 / sqrt(pow(tg.row - sf.row, 2) + pow(tg.col - sf.col, 2))) AS v
        FROM tg JOIN sf ON abs(tg.row - sf.row) <= 3 AND abs(tg.col - sf.col) <= 3 AND pow(tg.row - sf.row, 2) + pow(tg.col - sf.col, 2) <= 9 GROUP BY ALL)"""


@query("J15_fill_radius", IDW + " SELECT l.row, l.col, R6(coalesce(sf.v, iw.v)) AS v FROM v_land l LEFT JOIN sf USING (row, col) LEFT JOIN iw USING (row, col)")
def _(v):
    filled_field = spatial.fill_radius(sparse_field(v), v.land(), ["v"], 3)
    return filled_field.select("row", "col", r6(F.col("v")).alias("v"))


PLANE = """sf AS (SELECT row, col, (2 * row - 3 * col + 7)::DOUBLE AS v FROM v_land_field WHERE v <= 18 AND (row + col) % 3 < 2), """ + hull_sql("sf", "ed") + """,
    tg AS (SELECT row, col FROM v_land t ANTI JOIN sf USING (row, col)),
    nr AS (SELECT row, col FROM tg WHERE EXISTS (SELECT 1 FROM sf WHERE abs(sf.row - tg.row) <= 6 AND abs(sf.col - tg.col) <= 6 AND pow(sf.row - tg.row, 2) + pow(sf.col - tg.col, 2) <= 36)
        AND NOT EXISTS (SELECT 1 FROM ed WHERE (x2 - x1) * (tg.row - y1) - (y2 - y1) * (tg.col - x1) < 0))"""


@query("J15c_fill_linear", PLANE + """ SELECT l.row, l.col, R6(CASE WHEN sf.v IS NOT NULL THEN sf.v WHEN nr.row IS NOT NULL THEN (2 * l.row - 3 * l.col + 7)::DOUBLE END) AS v
    FROM v_land l LEFT JOIN sf USING (row, col) LEFT JOIN nr ON nr.row = l.row AND nr.col = l.col""")
def _(v):
    """Linear interpolation gives a tilted plane back wherever the hull and the radius allow."""
    field = v.land_field().where("v <= 18 AND (row + col) % 3 < 2").select("row", "col", F.expr("CAST(2 * row - 3 * col + 7 AS DOUBLE)").alias("v"))
    return triangulation.fill_linear(field, v.land(), ["v"], 6).select("row", "col", r6(F.col("v")).alias("v"))


@query("J16_fill_static", SPARSE + """ SELECT l.row, l.col, coalesce(sf.v, a.v) AS v FROM v_land l LEFT JOIN sf USING (row, col) LEFT JOIN (SELECT row, col, v FROM v_annual WHERE year = 1999) a USING (row, col)""")
def _(v):
    base = v.land().join(sparse_field(v), ["row", "col"], "left")
    return spatial.fill_static(base, v.annual().where("year = 1999").select("row", "col", "v"), ["v"])


@query("J17_fill_nearest", SPARSE + """, pr AS (SELECT t.row, t.col, sf.v, row_number() OVER (PARTITION BY t.row, t.col ORDER BY pow(t.row - sf.row, 2) + pow(t.col - sf.col, 2), sf.row, sf.col) AS rn
        FROM (SELECT row, col FROM v_land ANTI JOIN sf USING (row, col)) t JOIN sf ON abs(t.row - sf.row) <= 24 AND abs(t.col - sf.col) <= 24)
    SELECT row, col, v FROM sf UNION ALL SELECT row, col, v FROM pr WHERE rn = 1""")
def _(v):
    return spatial.fill_nearest(v.land().join(sparse_field(v), ["row", "col"], "left"), ["v"])


YEARLY = """sy AS (SELECT row, col, year, CASE WHEN v <= 20 + year % 7 THEN v END AS v FROM v_annual SEMI JOIN v_land USING (row, col)), ok AS (SELECT * FROM sy WHERE v IS NOT NULL), gp AS (SELECT row, col, year FROM sy WHERE v IS NULL)"""


def yearly_gaps(v):
    """A yearly cube on land whose larger values count as missing, another share each year."""
    kept = F.when(F.col("v") <= 20 + F.col("year") % 7, F.col("v"))
    return v.annual().join(v.land(), ["row", "col"], "left_semi").select("row", "col", "year", kept.alias("v"))


@query("J14b_nearest_valid_by_year", YEARLY + """, pr AS (SELECT gp.*, ok.row AS n_row, ok.col AS n_col, row_number() OVER (PARTITION BY gp.row, gp.col, gp.year ORDER BY pow(gp.row - ok.row, 2) + pow(gp.col - ok.col, 2), ok.row, ok.col) AS rank FROM gp JOIN ok USING (year))
    SELECT row, col, year, n_row, n_col, CAST(rank AS INTEGER) AS rank FROM pr WHERE rank <= 5""")
def _(v):
    cube = yearly_gaps(v)
    near = spatial.nearest(cube.where("v IS NULL"), cube.where("v IS NOT NULL"), 5, layers=["year"])
    return near.select("row", "col", "year", "n_row", "n_col", "rank")


@query("J15b_fill_radius_by_year", YEARLY + """, iw AS (SELECT gp.row, gp.col, year, sum(ok.v / sqrt(pow(gp.row - ok.row, 2) + pow(gp.col - ok.col, 2))) / sum(1 / sqrt(pow(gp.row - ok.row, 2) + pow(gp.col - ok.col, 2))) AS v
        FROM gp JOIN ok USING (year) WHERE pow(gp.row - ok.row, 2) + pow(gp.col - ok.col, 2) <= 9 GROUP BY ALL)
    SELECT sy.row, sy.col, sy.year, R6(coalesce(sy.v, iw.v)) AS v FROM sy LEFT JOIN iw USING (row, col, year)""")
def _(v):
    cube = yearly_gaps(v)
    out = spatial.fill_radius(cube, cube.select("row", "col", "year"), ["v"], 3, layers=["year"])
    return out.select("row", "col", "year", r6(F.col("v")).alias("v"))


@query("J17b_fill_nearest_by_year", YEARLY + """, pr AS (SELECT gp.row, gp.col, gp.year, ok.v, row_number() OVER (PARTITION BY gp.row, gp.col, gp.year ORDER BY pow(gp.row - ok.row, 2) + pow(gp.col - ok.col, 2), ok.row, ok.col) AS rn FROM gp LEFT JOIN ok USING (year))
    SELECT row, col, year, v FROM ok UNION ALL SELECT row, col, year, v FROM pr WHERE rn = 1""")
def _(v):
    return spatial.fill_nearest(yearly_gaps(v), ["v"], layers=["year"])


@query("J18_bracketing_interpolation", """a AS (SELECT row, col, year, v FROM v_annual WHERE v IS NOT NULL AND year IN (1996, 1998, 2000)), c AS (SELECT DISTINCT row, col FROM a),
    y AS (SELECT row, col, CAST(yy AS INTEGER) AS year FROM c, range(1995, 2002) AS g(yy)),
    b AS (SELECT y.row, y.col, y.year, (SELECT max(struct_pack(year := a.year, v := a.v)) FROM a WHERE a.row = y.row AND a.col = y.col AND a.year <= y.year) AS p, (SELECT min(struct_pack(year := a.year, v := a.v)) FROM a WHERE a.row = y.row AND a.col = y.col AND a.year >= y.year) AS n FROM y)
    SELECT row, col, year, R6(CASE WHEN p IS NULL THEN n.v WHEN n IS NULL THEN p.v WHEN p.year = n.year THEN p.v ELSE (1 - (year - p.year) / (n.year - p.year)::DOUBLE) * p.v + (year - p.year) / (n.year - p.year)::DOUBLE * n.v END) AS v FROM b""")
def _(v):
    anchors = v.annual().where("v IS NOT NULL AND year IN (1996, 1998, 2000)")
    out = temporal.bracket_interpolate(anchors, ["row", "col"], "year", "v", 1995, 2001)
    return out.select("row", "col", "year", r6(F.col("v")).alias("v"))


@query("J19_lockstep", "SELECT row, col, year, a.v, d.juv FROM v_annual a JOIN v_density d USING (row, col, year)")
def _(v):
    return temporal.lockstep(v.annual(), v.density().select("row", "col", "year", "juv"), ["row", "col", "year"])


@query("J20_key_alignment", """SELECT count(CASE WHEN f.row IS NOT NULL AND l.row IS NOT NULL THEN 1 END) AS matched, count(CASE WHEN l.row IS NULL THEN 1 END) AS only_z,
    count(CASE WHEN f.row IS NULL THEN 1 END) AS only_mask FROM v_field f FULL JOIN v_land l ON f.row = l.row AND f.col = l.col""")
def _(v):
    return temporal.alignment(v.field(), v.land(), ["row", "col"], "z", "mask")


@query("J21_prediction_lookup", """o AS (SELECT row, col, year, v FROM v_annual) SELECT row, col, year, o.v, greatest(coalesce(d.juv, 0) * 0.5::DOUBLE, 1e-6) AS mu FROM o LEFT JOIN (SELECT * FROM v_density WHERE juv <> 9) d USING (row, col, year)""")
def _(v):
    pred = v.density().where("juv <> 9").select("row", "col", "year", F.col("juv").alias("density"))
    return rates.predicted_counts(v.annual(), pred, 0.5, ["row", "col", "year"]).drop("density")


@query("J22_scatter_to_grid", """lw AS (SELECT row, col, year, arg_max(value, (month, value)) AS last_value FROM v_cells WHERE value IS NOT NULL GROUP BY ALL)
    SELECT l.row, l.col, l.year, coalesce(last_value, 0) AS field, last_value AS obs FROM (SELECT row, col, CAST(y AS INTEGER) AS year FROM v_land, range(1995, 2002) AS g(y)) l LEFT JOIN lw USING (row, col, year)""")
def _(v):
    last = temporal.last_wins(v.cells().where("value IS NOT NULL"), ["row", "col", "year"], "value", ["month", "value"])
    slots = survey.pseudo_zeros(v.land(), 1995, 2001).drop("n")
    out = slots.join(last.withColumnRenamed("value", "obs"), ["row", "col", "year"], "left")
    return out.withColumn("field", F.coalesce("obs", F.lit(0.0)))


@query("J23_patristic_distance", """up AS (SELECT child AS node, child AS anc, 0.0::DOUBLE AS d FROM v_edges UNION SELECT 'root', 'root', 0.0::DOUBLE UNION ALL
        SELECT up.node, e.parent, up.d + e.length FROM up JOIN v_edges e ON e.child = up.anc)
    SELECT a.node, min(a.d + b.d) AS distance FROM up a JOIN up b ON a.anc = b.anc AND b.node = 's3' WHERE a.node LIKE 's%' GROUP BY a.node""")
def _(v):
    edges = v.edges()
    return traits.patristic_distance(edges, "s3").where("node LIKE 's%'")


@query("J24_neighbour_join", """SELECT f.row + dr AS row, f.col + dc AS col, R6(sum(v)) AS total FROM v_land_field f, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) AS o(dr, dc) GROUP BY ALL""")
def _(v):
    around = focal.scatter(v.land_field(), {"box": focal.box(3)}, ["v"])
    return around.select("row", "col", r6(F.col("v")).alias("total"))
