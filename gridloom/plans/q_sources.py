"""Scans, audits and sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.plans.registry import query
from gridloom.plans.views import r6
from gridloom.sources import audit, scans, sinks

LAYERS = """v_layers AS (SELECT l_returnflag || l_linestatus AS var, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
    count(*) * 100 AS length FROM lineitem GROUP BY ALL)"""


def layers(v):
    return v.table("lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("var"),
        F.trunc("l_shipdate", "month").alias("month"),
    ).agg((F.count("*") * 100).alias("length"))


@query("S1_csv_scan", "SELECT visit, route, year, run_type FROM v_effort")
def _(v):
    out = sinks.staging(v.spark, "s1")
    sinks.write_csv(v.effort().withColumn("note", F.lit("x")).repartition(4), out)
    return scans.scan_csv(v.spark, [out], "visit BIGINT, route BIGINT, year INT, run_type INT, note STRING", ["visit", "route", "year", "run_type"])


@query("S2_tolerant_csv_scan", """SELECT CAST(visit AS VARCHAR) AS visit, CAST(route AS VARCHAR) AS route,
    2 AS n_skipped_dirs FROM v_effort""")
def _(v):
    good, other, bad = (sinks.staging(v.spark, f"s2{i}") for i in "abc")
    sinks.write_csv(v.effort().where("run_type = 1"), good)
    sinks.write_csv(v.effort().where("run_type = 0").select("route", "year", "visit"), other)
    sinks.write_csv(v.effort().select(F.col("visit").alias("broken")), bad)
    sinks.write_csv(v.effort().select(F.col("year").alias("wrong")), bad + "x")
    rows, skipped = scans.scan_csv_tolerant(v.spark, [good, other, bad, bad + "x"], ["visit", "route"])
    dirs = skipped.agg(F.countDistinct(F.regexp_extract("path", r"(.*)/[^/]+$", 1)).cast("int")).scalar()
    return rows.withColumn("n_skipped_dirs", dirs)


@query("S2b_corrupt_file_skip", "SELECT row, col, year, month, value, true AS some_skipped FROM v_cells")
def _(v):
    good, bad = sinks.staging(v.spark, "s2d"), sinks.staging(v.spark, "s2e")
    v.cells().write.parquet(good)
    v.table("nation").select("n_name").write.text(bad)
    rows, skipped = scans.scan_parquet_tolerant(v.spark, [good, bad], "row INT, col INT, year INT, month INT, value DOUBLE")
    return rows.withColumn("some_skipped", skipped.agg(F.count("*") > 0).scalar())


@query("S3_charset_fallback", """SELECT c_custkey, c_name || ' é' AS name FROM customer""")
def _(v):
    a, b = sinks.staging(v.spark, "s3a"), sinks.staging(v.spark, "s3b")
    named = v.table("customer").select("c_custkey", F.concat("c_name", F.lit(" é")).alias("name"))
    sinks.write_csv(named.where("c_nationkey < 12"), a, "UTF-8")
    sinks.write_csv(named.where("c_nationkey >= 12"), b, "ISO-8859-1")
    return scans.scan_csv_any_charset(v.spark, [a, b], "c_custkey BIGINT, name STRING")


@query("S4_coerce_keys", """SELECT CAST(o_custkey AS INTEGER) AS route, CAST(year(o_orderdate) AS INTEGER) AS year,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS DOUBLE) END AS total FROM orders WHERE o_orderpriority <> '5-LOW'""")
def _(v):
    raw = v.table("orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("route"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.when(F.col("o_orderstatus") == "P", "??").otherwise(F.col("o_orderkey").cast("string")).alias("total"),
    )
    return scans.coerce_keys(raw, ["route", "year"], ["total"])


@query("S5_raster_scan", "SELECT row, col, year, month, value FROM v_cells")
def _(v):
    raw = v.cells().withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    return scans.nan_to_null(raw, ["value"])


@query("S6_dimensions_from_names", """SELECT species, count(*) AS n, min(d) AS first_date, max(d) AS last_date,
    (SELECT count(*) FROM v_files WHERE path NOT LIKE '%.tif') AS n_unmatched
    FROM (SELECT split_part(path, '_abundance', 1) AS species, CAST(replace(split_part(path, 'median_', 2), '.tif', '') AS DATE) AS d
          FROM v_files WHERE path LIKE '%.tif') GROUP BY species""")
def _(v):
    parsed = v.files().select("path", *[c.alias(n) for n, c in text.parse_layer_name(F.col("path")).items()])
    unmatched = parsed.where("species IS NULL").agg(F.count("*")).scalar()
    return parsed.where("species IS NOT NULL").groupBy("species").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    ).withColumn("n_unmatched", unmatched)


MONTHS = """ml AS (SELECT DISTINCT l_returnflag || l_linestatus AS var, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month FROM lineitem)"""


@query("S6b_dimensions_from_paths", MONTHS + ", n AS (SELECT lower(var) AS var, year, month, CAST(NULL AS INTEGER) AS band FROM ml), y AS (SELECT DISTINCT lower(var) AS var, year, CAST(NULL AS INTEGER) AS month, CAST(month % 3 AS INTEGER) AS band FROM ml) SELECT var, year, month, band, count(*) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM y) GROUP BY ALL")
def _(v):
    # one file per (variable, month) and per (variable, year, band); the names alone carry the dimensions
    out = sinks.staging(v.spark, "s6b")
    line = v.table("lineitem").select(
        F.lower(F.concat("l_returnflag", "l_linestatus")).alias("var"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
    ).distinct()
    month = F.concat("var", F.lit("_"), "year", F.lpad(F.col("month").cast("string"), 2, "0"), F.lit(".tif"))
    band = F.concat("var", F.lit("_"), "year", F.lit("_band"), F.pmod("month", F.lit(3)), F.lit(".tif"))
    names = line.select(F.explode(F.array(month, band)).alias("name")).distinct()
    names.select("name", F.lit("x").alias("value")).write.partitionBy("name").text(out)
    path = F.regexp_replace(F.col("_metadata.file_path"), "/part-[^/]*$", "")
    files = v.spark.read.text(out).select(F.regexp_extract(path, "name=([^/]+)$", 1).alias("path"))
    by_month, by_band = text.parse_month_name(F.col("path")), text.parse_band_name(F.col("path"))
    parsed = files.select(
        F.coalesce(by_month["var"], by_band["name"]).alias("var"), F.coalesce(by_month["year"], by_band["year"]).alias("year"),
        by_month["month"].alias("month"), by_band["band"].alias("band"),
    )
    return parsed.groupBy("var", "year", "month", "band").agg(F.count("*").alias("n"))


# a threshold that leaves gaps in the species x week product, relative to the table's own values
@query("S7_grid_completeness", """q AS (SELECT avg(x) AS t FROM v_abund), k AS (SELECT DISTINCT species, week FROM v_abund WHERE (week * 7 + length(species) + ascii(right(species, 1))) % 5 <> 0 AND x > (SELECT t FROM q)), s AS (SELECT DISTINCT species FROM k),
    w AS (SELECT DISTINCT week FROM k)
    SELECT species, week, (SELECT count(*) FROM k) = (SELECT count(*) FROM s) * (SELECT count(*) FROM w) AS complete
    FROM s, w WHERE (species, week) NOT IN (SELECT (species, week) FROM k)""")
def _(v):
    gap = F.pmod(F.col("week") * 7 + F.length("species") + F.ascii(F.right(F.col("species"), F.lit(1))), F.lit(5)) == 0
    mean = v.abund().agg(F.avg("x")).scalar()
    keys = v.abund().where(~gap & (F.col("x") > mean)).select("species", "week").distinct()
    complete = audit.completeness(keys, "species", "week").select("complete").scalar()
    return audit.missing_combinations(keys, "species", "week").withColumn("complete", complete)


S8 = LAYERS + """, cal AS (SELECT DISTINCT var, CAST(m AS DATE) AS month FROM v_layers,
    range(DATE '1994-11-01', DATE '2002-01-01', INTERVAL 1 MONTH) AS g(m))"""


@query("S8_calendar_audit", S8 + """ SELECT var, month, CASE WHEN length IS NULL THEN 'missing' WHEN length < 10000 THEN 'corrupt' ELSE 'ok' END AS status
    FROM cal LEFT JOIN v_layers USING (var, month)""")
def _(v):
    return audit.audit_calendar(layers(v), "var", "1994-11-01", "2001-12-01", 10_000)


@query("S9_work_list", S8 + " SELECT var, month FROM cal LEFT JOIN v_layers USING (var, month) WHERE length IS NULL OR length < 10000")
def _(v):
    return audit.work_list(layers(v), "var", "1994-11-01", "2001-12-01", 10_000)


@query("S10_metadata_consistency", """m AS (SELECT count(DISTINCT p_size) AS a, count(DISTINCT p_size > 0) AS b, count(DISTINCT p_type) AS c FROM part)
    SELECT 'res' AS field, a AS n_values, a = 1 AS consistent FROM m UNION ALL SELECT 'crs', b, b = 1 FROM m UNION ALL SELECT 'bounds', c, c = 1 FROM m""")
def _(v):
    meta = v.table("part").select(
        F.col("p_brand").alias("layer"), F.col("p_size").alias("res"),
        F.when(F.col("p_size") > 0, "albers").alias("crs"), F.col("p_type").alias("bounds"),
    )
    return audit.metadata_consistency(meta, ["res", "crs", "bounds"])


@query("S11_resume_write", "SELECT year, count(*) AS n, R6(sum(v)) AS total FROM v_annual GROUP BY year")
def _(v):
    whole = v.annual()
    out = sinks.staging(v.spark, "s11")
    sinks.write_missing_years(whole.where("year <= 1997"), out)
    sinks.write_missing_years(whole, out)
    stored = sinks.write_missing_years(whole, out)
    return stored.groupBy("year").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))


@query("S12_csv_sink", "SELECT row, col, year, v FROM v_annual")
def _(v):
    out = sinks.staging(v.spark, "s12")
    sinks.write_csv(v.annual(), out)
    return scans.scan_csv(v.spark, [out], "row INT, col INT, year INT, v DOUBLE", ["row", "col", "year", "v"])


@query("S13_yearly_sink", "SELECT row, col, v, year FROM v_annual")
def _(v):
    out = sinks.staging(v.spark, "s13")
    sinks.write_yearly(v.annual(), out)
    return v.spark.read.parquet(out)


@query("S14_land_slices", "SELECT row, col, v, year FROM v_annual SEMI JOIN v_land USING (row, col)")
def _(v):
    out = sinks.staging(v.spark, "s14")
    sinks.write_land_slices(v.annual(), v.land(), out)
    return v.spark.read.parquet(out)


@query("S15_mask_fallback", "SELECT DISTINCT row, col, true AS rebuilt FROM v_cells WHERE value IS NOT NULL UNION ALL SELECT row, col, false FROM v_land")
def _(v):
    rebuilt = scans.load_mask(v.cells()).withColumn("rebuilt", F.lit(True))
    return rebuilt.unionByName(scans.load_mask(v.cells(), v.land()).withColumn("rebuilt", F.lit(False)))
