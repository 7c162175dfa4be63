"""Sorts, top-k, sampling, splits, fronts, set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import sampling, similarity, survey, temporal, traits
from gridloom.plans.registry import query


@query("T1_species_major_vectors", """SELECT cell, list(species ORDER BY species, week) AS species, list(week ORDER BY species, week) AS weeks, list(x ORDER BY species, week) AS vec FROM v_abund GROUP BY cell""")
def _(v):
    f = similarity.feature_vectors(v.abund(), "cell")
    return f.select("cell", F.col("features.species").alias("species"), F.col("features.week").alias("weeks"), "vec")


@query("T2_top_and_bottom", """t AS (SELECT part, qty, row_number() OVER (ORDER BY qty DESC, part) AS a, row_number() OVER (ORDER BY qty, part) AS b FROM v_traits)
    SELECT part, qty, CAST(a AS INTEGER) AS rank, 'top' AS side FROM t WHERE a <= 10 UNION ALL SELECT part, qty, CAST(b AS INTEGER), 'bottom' FROM t WHERE b <= 10""")
def _(v):
    return traits.top_and_bottom(v.traits().select("part", "qty"), "qty", "part", 10)


@query("T2b_top_by_magnitude", "SELECT row, col, v - 25 AS s FROM v_land_field ORDER BY abs(v - 25) DESC, row, col LIMIT 15")
def _(v):
    s = v.land_field().select("row", "col", (F.col("v") - 25).alias("s"))
    return s.orderBy(F.desc(F.abs("s")), "row", "col").limit(15)


SITES = "st AS (SELECT row, col, md5('42|' || row || '|' || col) AS h FROM v_land)"


@query("T3_seeded_site_sample", SITES + ", r AS (SELECT row, col, row_number() OVER (ORDER BY h, row, col) AS rn FROM st) SELECT row, col FROM r WHERE rn <= greatest(50, (SELECT floor(count(*) * 0.25) FROM st))")
def _(v):
    n = v.land().agg(F.greatest(F.lit(50), F.floor(F.count("*") * 0.25))).scalar()
    return sampling.sample_share(v.land(), ["row", "col"], n, 42)


@query("T4_cells_per_year", """h AS (SELECT row, col, year, v, md5('7|' || year || '|' || row || '|' || col) AS h FROM v_annual WHERE v IS NOT NULL)
    SELECT row, col, year, v FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY h, row, col) AS rn FROM h) WHERE rn <= 200""")
def _(v):
    return sampling.sample_per_group(v.annual().where("v IS NOT NULL"), "year", ["row", "col"], 200, 7)


@query("T5_landmarks", SITES + " SELECT row, col FROM st ORDER BY h, row, col LIMIT 64")
def _(v):
    return sampling.sample_fixed(v.land(), ["row", "col"], 64, 42)


PAIRS = """a AS (SELECT vec_id, row_number() OVER (ORDER BY md5('5|' || vec_id), vec_id) AS pair FROM embeddings), b AS (SELECT vec_id, row_number() OVER (ORDER BY md5('6|' || vec_id), vec_id) AS pair FROM embeddings)"""


@query("T6_random_pairs", PAIRS + " SELECT CAST(a.pair AS INTEGER) AS pair, a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM a JOIN b USING (pair) WHERE a.pair <= 200")
def _(v):
    return sampling.sample_pairs(v.table("embeddings"), "vec_id", 200, 5)


@query("T7_block_split", """s AS (SELECT max(row) + 1 AS h FROM v_grid), e AS (SELECT row, col, v, h // 8 AS q, h % 8 AS m FROM v_land_field, s),
    b AS (SELECT row, col, v, CAST(CASE WHEN row < m * (q + 1) THEN row // (q + 1) ELSE m + (row - m * (q + 1)) // greatest(q, 1) END AS INTEGER) * 8 + col // 4 AS blk FROM e),
    d AS (SELECT blk, row_number() OVER (ORDER BY blk) <= (SELECT floor(count(DISTINCT blk) * 0.8) FROM b) AS is_train FROM (SELECT DISTINCT blk FROM b)) SELECT row, col, v, is_train FROM b JOIN d USING (blk)""")
def _(v):
    h = v.grid().agg(F.max("row") + 1).scalar()
    f = v.land_field().withColumn("_h", h)
    return sampling.block_split(f, F.col("_h"), F.lit(32)).drop("_h")


@query("T8_row_split", "SELECT row, col, ('0x' || substr(md5('3|' || row || '|' || col), 1, 8))::BIGINT % 100 < 80 AS is_train FROM v_land")
def _(v):
    return sampling.row_split(v.land(), ["row", "col"], 3)


@query("T9_pareto_front", """s AS (SELECT part, price AS rank, qty AS rmse FROM v_traits) SELECT part, rank, rmse FROM s WHERE NOT EXISTS
    (SELECT 1 FROM s o WHERE o.rank >= s.rank AND o.rmse <= s.rmse AND (o.rank > s.rank OR o.rmse < s.rmse))""")
def _(v):
    s = v.traits().select("part", F.col("price").alias("rank"), F.col("qty").alias("rmse"))
    return sampling.pareto_front(s, "rank", "rmse")


@query("T10_grid_window", "SELECT row, col, year, v FROM v_annual WHERE row BETWEEN 5 AND 64 AND col BETWEEN 3 AND 22")
def _(v):
    return sampling.grid_window(v.annual(), 5, 3, 60, 20)


@query("T11_nearest_available_year", """SELECT row, col, year, v FROM v_annual WHERE year = coalesce((SELECT max(year) FROM v_annual WHERE year = 2010), (SELECT max(year) FROM v_annual))""")
def _(v):
    a = v.annual()
    return a.where(F.col("year") == temporal.latest_available(a, "year", 2010))


@query("U1_pseudo_and_real", """SELECT row, col, CAST(y AS INTEGER) AS year, 0::BIGINT AS n, true AS is_pseudo FROM v_land, range(1995, 1998) AS g(y)
    UNION ALL SELECT CAST(route // 32 AS INTEGER), CAST(route % 32 AS INTEGER), year, coalesce(n, 0), false FROM v_effort LEFT JOIN (SELECT visit, n FROM v_counts WHERE species = 'SMALL') USING (visit) WHERE run_type = 1""")
def _(v):
    obs = survey.zero_fill_counts(v.effort().where("run_type = 1"), v.counts().where("species = 'SMALL'").drop("species"), ["visit"])
    real = obs.select(F.floor(F.col("route") / 32).cast("int").alias("row"), F.pmod("route", F.lit(32)).cast("int").alias("col"), "year", "n")
    return survey.merge_observations(survey.pseudo_zeros(v.land(), 1995, 1997), real)


@query("U2_union_of_tables", """SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT r_regionkey, r_name, NULL, NULL FROM region
    UNION ALL SELECT CAST(s_suppkey AS INTEGER), s_name, NULL, s_acctbal FROM supplier""")
def _(v):
    a = v.table("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = v.table("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    c = v.table("supplier").select(F.col("s_suppkey").cast("int").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("U3_distinct_locations", "SELECT DISTINCT row, col FROM v_cells WHERE value IS NOT NULL")
def _(v):
    return v.cells().where("value IS NOT NULL").select("row", "col").distinct()


@query("U4_mask_set_operations", """a AS (SELECT row, col FROM v_annual WHERE v IS NOT NULL AND year = 1996), b AS (SELECT row, col FROM v_annual WHERE v IS NOT NULL AND year = 2001)
    SELECT 'both' AS op, row, col FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', row, col FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'lost', row, col FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _(v):
    valid = v.annual().where("v IS NOT NULL")
    a, b = valid.where("year = 1996").select("row", "col"), valid.where("year = 2001").select("row", "col")

    def tag(df, name):
        return df.select(F.lit(name).alias("op"), "row", "col")

    return tag(a.intersect(b), "both").unionByName(tag(a.union(b).distinct(), "either")).unionByName(tag(a.exceptAll(b), "lost"))


@query("U5_bag_of_vectors", """SELECT row, col, year, [v, juv, adult] AS vec FROM v_annual JOIN v_density USING (row, col, year) WHERE v IS NOT NULL""")
def _(v):
    whole = v.annual().where("v IS NOT NULL").join(v.density(), ["row", "col", "year"])
    return whole.select("row", "col", "year", F.array("v", "juv", "adult").alias("vec"))
