"""Cleaning, predicates, masks, normalisation, names."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import geo, links, text
from gridloom.operators import clean, grid
from gridloom.plans.registry import query
from gridloom.plans.views import r6

DIRTY = """v_dirty AS (SELECT row, col, year, month, CASE WHEN value = 17 THEN -9999.0 WHEN value = 18 THEN -99.0 WHEN value = 19 THEN 1e20
    WHEN value = 20 AND month = 2 THEN -2000.0 - row ELSE value END::DOUBLE AS value FROM v_cells)"""


def dirty(v):
    x = F.col("value")
    return v.cells().withColumn(
        "value",
        F.when(x == 17, -9999.0).when(x == 18, -99.0).when(x == 19, 1e20)
        .when((x == 20) & (F.col("month") == 2), -2000.0 - F.col("row")).otherwise(x),
    )


@query("P1_fill_values", DIRTY + " SELECT row, col, year, month, CASE WHEN value <> 1e20 THEN value END AS value FROM v_dirty")
def _(v):
    return clean.replace_fill(dirty(v), [1e20])


@query("P2_sentinels", DIRTY + " SELECT row, col, year, month, CASE WHEN value NOT IN (-9999, -999, -99) THEN value END AS value FROM v_dirty")
def _(v):
    return clean.replace_sentinels(dirty(v))


@query("P3_range_report", DIRTY + """, b AS (SELECT * FROM v_dirty WHERE value < -1000 AND value <> -9999)
    SELECT (SELECT count(value) FROM v_dirty WHERE value <> -9999) AS n_checked, (SELECT count(*) FROM b) AS n_bad,
    value AS min_bad, row AS bad_row, col AS bad_col FROM b ORDER BY value, row, col LIMIT 1""")
def _(v):
    return clean.range_report(clean.replace_fill(dirty(v), [-9999.0]), -1000.0)


@query("P3b_range_assertion", "SELECT row, col, year, month, value FROM v_cells")
def _(v):
    return clean.assert_range(v.cells(), -1000.0)


@query("P4_apply_mask", """SELECT row, col, year, month, CASE WHEN is_ocean = 0 THEN value END AS value FROM v_cells JOIN v_grid USING (row, col)""")
def _(v):
    return clean.apply_mask(v.cells(), v.grid())


@query("P5_ocean_mask", "SELECT row, col, CAST(count(value) = 0 AS INTEGER) AS is_ocean FROM v_cells GROUP BY row, col")
def _(v):
    return clean.ocean_mask(v.cells())


@query("P6_strict_mask", """a AS (SELECT row, col FROM v_cells GROUP BY ALL HAVING count(value) > 0),
    b AS (SELECT row, col FROM v_annual WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL HAVING count(DISTINCT CASE WHEN v IS NOT NULL THEN year END) = 5 AND count(*) = count(v))
    SELECT row, col FROM a SEMI JOIN b USING (row, col) SEMI JOIN v_land USING (row, col)""")
def _(v):
    bands = v.annual().where("year BETWEEN 1996 AND 2000").withColumnsRenamed({"year": "band", "v": "value"})
    return clean.strict_mask(clean.any_valid(v.cells()), clean.all_valid(bands, 5), v.land())


@query("P7_strict_pixels", """m AS (SELECT row, col FROM v_cells WHERE year = 1998 GROUP BY ALL HAVING count(DISTINCT CASE WHEN value IS NOT NULL THEN month % 4 END) = 4 AND count(*) = count(value))
    SELECT m.row, m.col FROM m JOIN v_annual a ON m.row = a.row AND m.col = a.col AND a.year = 1999 AND a.v IS NOT NULL""")
def _(v):
    months = v.cells().where("year = 1998").withColumn("band", F.pmod("month", F.lit(4)))
    band6 = v.annual().where("year = 1999 AND v IS NOT NULL").select("row", "col")
    return clean.strict_mask(clean.all_valid(months, 4), band6)


@query("P8_drop_incomplete", """SELECT part, size, price, qty, disc FROM v_traits WHERE disc IS NOT NULL""")
def _(v):
    return clean.drop_incomplete(v.traits(), ["size", "price", "qty", "disc"])


@query("P9_zero_fill", "SELECT row, col, year, coalesce(v, 0) AS v FROM v_annual")
def _(v):
    return clean.zero_fill(v.annual(), ["v"])


@query("P11_native_range", """SELECT row, col, year, n FROM (SELECT CAST(o_custkey // 32 AS INTEGER) AS row, CAST(o_custkey % 32 AS INTEGER) AS col,
    CAST(year(o_orderdate) AS INTEGER) AS year, n FROM orders JOIN v_counts ON o_orderkey = visit AND species = 'SMALL') WHERE year <= 1997 AND n > 0 AND col < 21""")
def _(v):
    from gridloom.operators.survey import native_range

    seen = v.counts().where("species = 'SMALL'").join(v.effort(), "visit")
    cells = seen.select(F.floor(F.col("route") / 32).cast("int").alias("row"), F.pmod("route", F.lit(32)).cast("int").alias("col"), "year", "n")
    return native_range(cells, last_year=1997, ncols=32)


@query("P12_bounds_check", """SELECT row, col, year, month, value FROM v_cells SEMI JOIN v_land USING (row, col) WHERE row BETWEEN 0 AND (SELECT max(row) FROM v_grid) AND col BETWEEN 0 AND 31""")
def _(v):
    from gridloom.operators.survey import in_bounds

    return in_bounds(v.cells(), v.grid().agg(F.max("row") + 1).scalar(), F.lit(32), v.land())


@query("P13_time_index", "SELECT row, col, year - 1996 AS t, v FROM v_annual WHERE year BETWEEN 1996 AND 2000")
def _(v):
    from gridloom.operators.survey import time_index

    return time_index(v.annual(), 1996, 2000).select("row", "col", "t", "v")


P14 = """p AS (SELECT c_custkey, -2000000.0 + (c_custkey % 997) * 4000.5 AS x, 3000000.0 - (c_custkey % 613) * 4000.25 AS y FROM customer)"""


@query("P14_affine_index", P14 + """ SELECT c_custkey, CAST(floor((3000000.0 - y) / 25000) AS INTEGER) AS row, CAST(floor((x + 2000000.0) / 25000) AS INTEGER) AS col FROM p""")
def _(v):
    key = F.col("c_custkey")
    x, y = F.lit(-2000000.0) + F.pmod(key, F.lit(997)) * 4000.5, F.lit(3000000.0) - F.pmod(key, F.lit(613)) * 4000.25
    row, col = geo.to_index(x, y, F.lit(-2000000.0), F.lit(3000000.0), F.lit(25000.0))
    return v.table("customer").select(key, row.alias("row"), col.alias("col"))


ALBERS = """k AS (SELECT (sin(radians(29.5)) + sin(radians(45.5))) / 2 AS n), kc AS (SELECT n, pow(cos(radians(29.5)), 2) + 2 * n * sin(radians(29.5)) AS c FROM k),
    ll AS (SELECT c_custkey, -124.0 + (c_custkey % 997) * 0.055 AS lon, 26.0 + (c_custkey % 613) * 0.035 AS lat FROM customer),
    xy AS (SELECT c_custkey, 6371007.2 * sqrt(c - 2 * n * sin(radians(lat))) / n * sin(n * radians(lon + 96.0)) AS x,
        6371007.2 * sqrt(c - 2 * n * sin(radians(23.0))) / n - 6371007.2 * sqrt(c - 2 * n * sin(radians(lat))) / n * cos(n * radians(lon + 96.0)) AS y FROM ll, kc)"""


def points(v):
    key = F.col("c_custkey")
    lon, lat = F.lit(-124.0) + F.pmod(key, F.lit(997)) * 0.055, F.lit(26.0) + F.pmod(key, F.lit(613)) * 0.035
    x, y = geo.Albers().project(lon, lat)
    return v.table("customer").select(key, x.alias("x"), y.alias("y"))


@query("P15_equal_area_projection", ALBERS + " SELECT c_custkey, round(x, 2) AS x, round(y, 2) AS y FROM xy")
def _(v):
    return points(v).select("c_custkey", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("P16_point_sampling", ALBERS + """, pt AS (SELECT c_custkey, CAST(floor((3300000.0 - y) / 90000) AS INTEGER) AS row, CAST(floor((x + 2600000.0) / 160000) AS INTEGER) AS col FROM xy)
    SELECT c_custkey, row, col, is_ocean FROM pt LEFT JOIN v_grid USING (row, col)""")
def _(v):
    row, col = geo.to_index(F.col("x"), F.col("y"), F.lit(-2600000.0), F.lit(3300000.0), F.lit(1.0))
    at = points(v).select("c_custkey", F.floor(row / 90000).cast("int").alias("row"), F.floor(col / 160000).cast("int").alias("col"))
    return grid.sample_points(at, v.grid()).select("c_custkey", "row", "col", "is_ocean")


# every cell is a target, so edges and targets beyond the source are met too
TARGET = "tg AS (SELECT row, col FROM v_grid)"


def target(v):
    return v.grid().select("row", "col")


@query("P17_nearest_regrid", TARGET + """ SELECT tg.row, tg.col, g.is_ocean FROM tg LEFT JOIN v_grid g ON g.row = CAST(floor((tg.row + 0.5) * 1.5) AS INTEGER) AND g.col = CAST(floor((tg.col + 0.5) * 1.5) AS INTEGER)""")
def _(v):
    return grid.nearest_regrid(target(v), v.grid(), 1.5, "is_ocean").select("row", "col", "is_ocean")


@query("P18_bilinear_regrid", TARGET + """, f AS (SELECT tg.row, tg.col, (tg.row + 0.5) * 1.5::DOUBLE - 0.5 AS y, (tg.col + 0.5) * 1.5::DOUBLE - 0.5 AS x FROM tg),
    k AS (SELECT f.row, f.col, floor(y) + dr AS sr, floor(x) + dc AS sc, (CASE dr WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dc WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w
        FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dr, dc)),
    j AS (SELECT k.row, k.col, w, v FROM k LEFT JOIN v_land_field s ON s.row = sr AND s.col = sc WHERE w > 0)
    SELECT row, col, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 10) AS value FROM j GROUP BY row, col""")
def _(v):
    src = clean.apply_mask(v.field(), v.grid(), "v").withColumnRenamed("v", "value")
    # weights are quarters, so six digits would meet exact ties
    return grid.bilinear_regrid(target(v), src, 1.5).select("row", "col", F.round("value", 10).alias("value"))


@query("P20_colmajor_index", """h AS (SELECT max(row) + 1 AS h FROM v_grid), f AS (SELECT row, col, CAST(col AS BIGINT) * h + row + 1 AS flat, h FROM v_grid, h)
    SELECT row, col, flat, CAST((flat - 1) % h AS INTEGER) AS row2, CAST((flat - 1) // h AS INTEGER) AS col2 FROM f""")
def _(v):
    g = v.grid()
    n = g.agg(F.max("row") + 1).scalar()
    flat = g.select("row", "col", geo.to_colmajor(F.col("row"), F.col("col"), n).alias("flat"))
    row, col = geo.from_colmajor(F.col("flat"), n)
    return flat.select("row", "col", "flat", row.alias("row2"), col.alias("col2"))


@query("P21_cell_size", """SELECT p_partkey, CASE WHEN p_type LIKE 'S%' THEN p_size / 1000.0::DOUBLE WHEN p_type LIKE 'M%' THEN p_size * 111.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS km FROM part""")
def _(v):
    units = F.when(F.col("p_type").startswith("S"), "metre").when(F.col("p_type").startswith("M"), "degree").otherwise("km")
    return v.table("part").select("p_partkey", geo.cell_size_km(F.col("p_size").cast("double"), units).alias("km"))


@query("P22_log_bins", """s AS (SELECT list_concat([0.0], [pow(10, 1 + (3.0 - 1.0) * i / 5) FOR i IN range(1, 5)], [1e9]) AS splits)
    SELECT CAST(len(list_filter(splits, lambda b: b <= l_extendedprice / 100)) - 1 AS INTEGER) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1""")
def _(v):
    splits = geo.log_splits(10.0, 1000.0, 5)
    return v.table("lineitem").groupBy(geo.split_index(F.col("l_extendedprice") / 100, splits).alias("bin")).agg(F.count("*").alias("n"))


@query("P23_transforms", """SELECT row, col, year, R6(CASE WHEN v - 10 >= 0 THEN pow(v - 10, 0.25) END) AS p, R6(pow(greatest(v - 10, 0), 0.5)) AS clipped,
    R6(log10(v)) AS l10, R6(ln(v + 1)) AS l1 FROM v_annual WHERE v IS NOT NULL""")
def _(v):
    x = F.col("v")
    return v.annual().where("v IS NOT NULL").select(
        "row", "col", "year", r6(links.power(x - 10, 0.25)).alias("p"), r6(links.power(x - 10, 0.5, "clip")).alias("clipped"),
        r6(F.log10(x)).alias("l10"), r6(F.log1p(x)).alias("l1"),
    )


@query("P24_zscore", """SELECT part, R6((size - (SELECT avg(size) FROM v_traits)) / (SELECT stddev_samp(size) FROM v_traits)) AS size,
    R6((qty - (SELECT avg(qty) FROM v_traits)) / (SELECT stddev_samp(qty) FROM v_traits)) AS qty,
    R6((disc - (SELECT avg(disc) FROM v_traits)) / (SELECT stddev_samp(disc) FROM v_traits)) AS disc, 0.0::DOUBLE AS flat FROM v_traits""")
def _(v):
    t = v.traits().withColumn("flat", F.lit(1.0))
    z = clean.standardize(t, ["size", "qty", "disc", "flat"])
    return z.select("part", r6(F.col("size")).alias("size"), r6(F.col("qty")).alias("qty"), r6(F.col("disc")).alias("disc"), "flat")


@query("P25_normalize_by_other_slice", """p AS (SELECT row, col, year, month, pow(value, 0.1) AS v FROM v_cells WHERE value IS NOT NULL),
    s AS (SELECT month, avg(v) AS mu, stddev_samp(v) AS ss, stddev_pop(v) AS sp FROM p WHERE year = 2000 GROUP BY month)
    SELECT row, col, year, month, R6((v - mu) / (ss + 1e-6)) AS z_sample, R6((v - mu) / (sp + 1e-6)) AS z_pop FROM p LEFT JOIN s USING (month) WHERE year <> 2000""")
def _(v):
    p = v.cells().where("value IS NOT NULL").withColumn("v", links.power(F.col("value"), 0.1, "clip"))
    ref = p.where("year = 2000")
    both = p.where("year <> 2000").withColumns({"z_sample": F.col("v"), "z_pop": F.col("v")})
    out = clean.normalize_by(both, ref.withColumnRenamed("v", "z_sample"), "month", "z_sample")
    out = clean.normalize_by(out, ref.withColumnRenamed("v", "z_pop"), "month", "z_pop", sample=False)
    return out.select("row", "col", "year", "month", r6(F.col("z_sample")).alias("z_sample"), r6(F.col("z_pop")).alias("z_pop"))


@query("P26_P27_names", """SELECT c_custkey, replace(lower(trim('  ' || replace(c_name, '#', '_ ') || ' ')), '_', ' ') AS norm,
    replace(c_mktsegment || ' bird', ' ', '_') AS label FROM customer""")
def _(v):
    raw = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("_ ")), F.lit(" "))
    return v.table("customer").select(
        "c_custkey", text.normalize_name(raw).alias("norm"), text.underscored(F.concat("c_mktsegment", F.lit(" bird"))).alias("label")
    )


@query("P28_scientific_name", """SELECT s_suppkey, n_name AS in_parens, s_name AS whole FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(v):
    labelled = v.table("supplier").join(v.taxonomy(), F.col("s_nationkey") == F.col("nk"))
    return labelled.select("s_suppkey", text.scientific_name(F.col("common")).alias("in_parens"), text.scientific_name(F.col("s_name")).alias("whole"))


@query("P29_display_label", """b AS (SELECT user_id, day, CASE WHEN user_id % 3 = 0 THEN lower(n_name) ELSE 'code' || user_id % 7 END AS code FROM v_series LEFT JOIN nation ON n_nationkey = user_id % 25),
    l AS (SELECT user_id, day, coalesce(common, b.code) || ' | ' || strftime(day, '%b %d') AS label FROM b LEFT JOIN v_taxonomy t ON lower(t.code) = b.code)
    SELECT user_id, day, label, split_part(label, ' | ', 1) AS species, split_part(label, ' | ', 2) AS date_label FROM l""")
def _(v):
    nat = v.table("nation").select("n_nationkey", "n_name")
    key = F.pmod("user_id", F.lit(25)).cast("int")
    base = v.series().join(nat, key == F.col("n_nationkey"), "left").withColumn(
        "code", F.when(F.pmod("user_id", F.lit(3)) == 0, F.lower("n_name")).otherwise(F.concat(F.lit("code"), F.pmod("user_id", F.lit(7)).cast("string")))
    )
    tax = v.taxonomy().select(F.lower("code").alias("code"), "common")
    label = F.concat_ws(" | ", F.coalesce("common", "code"), F.date_format("day", "MMM dd"))
    return base.join(tax, "code", "left").select("user_id", "day", label.alias("label")).withColumns({
        "species": F.split_part("label", F.lit(" | "), F.lit(1)),
        "date_label": F.split_part("label", F.lit(" | "), F.lit(2)),
    })
