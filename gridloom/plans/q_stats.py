"""Aggregates, distributions, correlations, fit scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import ordering, vectors
from gridloom.operators import grid, rates, sampling, similarity, stats, survey, temporal
from gridloom.plans.q_joins import SMALL, VISITS, filled, fine_cell
from gridloom.plans.q_rates import BETA_S, B_SQL, R0, r0
from gridloom.plans.registry import query
from gridloom.plans.views import r6

H = "h AS (SELECT (max(row) + 1) AS h FROM v_grid)"


def shape(v):
    return v.grid().agg(F.max("row") + 1).scalar(), F.lit(32)


@query("A1_block_mean", H + " SELECT year, CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, round(avg(v), 8) AS v FROM v_annual, h WHERE row < h // 4 * 4 GROUP BY ALL")
def _(v):
    # means of 16 averages can end in an exact 5 at the seventh digit: round beyond it
    out = grid.block_reduce(v.annual(), 4, *shape(v), keys=["year"], column="v")
    return out.withColumn("v", F.round("v", 8))


@query("A2_block_max", H + """, b AS (SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, max(v) AS v FROM v_annual, h WHERE row < h // 4 * 4 GROUP BY row // 4, col // 4),
    l AS (SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, max(1 - is_ocean) AS land FROM v_grid, h WHERE row < h // 4 * 4 GROUP BY row // 4, col // 4) SELECT row, col, v * land AS v FROM b JOIN l USING (row, col)""")
def _(v):
    a = grid.block_reduce(v.annual(), 4, *shape(v), how="max", column="v")
    land = grid.block_reduce(v.grid().withColumn("land", 1 - F.col("is_ocean")), 4, *shape(v), how="max", column="land")
    return a.join(land, ["row", "col"]).select("row", "col", (F.col("v") * F.col("land")).alias("v"))


PROBS = [0.05, 0.25, 0.5, 0.75, 0.9, 0.97, 0.99]


@query("A3_block_quantiles", f"""q AS (SELECT year, CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, quantile_cont(v, {PROBS}) AS q FROM v_annual GROUP BY ALL)
    SELECT year, row, col, CAST(b AS INTEGER) AS band, R6(q[b]) AS v FROM q, range(1, 8) AS g(b)""")
def _(v):
    out = grid.block_quantiles(v.annual(), 4, PROBS, ["year"], "v")
    return out.withColumn("v", r6(F.col("v")))


@query("A4_quantile_threshold", "SELECT part, qty FROM v_traits WHERE qty > (SELECT quantile_cont(qty, 0.75) FROM v_traits)")
def _(v):
    t = v.traits().select("part", "qty")
    return t.where(F.col("qty") > ordering.exact_quantiles(t, "qty", [0.75], ["q"]).scalar())


@query("A5_multiband_mean_sum", """SELECT row, col, year, avg(CASE WHEN month <= 6 THEN value END) AS mean_first, coalesce(sum(CASE WHEN month > 6 THEN value END), 0) AS sum_second FROM v_cells GROUP BY ALL""")
def _(v):
    first, second = F.when(F.col("month") <= 6, F.col("value")), F.when(F.col("month") > 6, F.col("value"))
    return v.cells().groupBy("row", "col", "year").agg(F.avg(first).alias("mean_first"), F.coalesce(F.sum(second), F.lit(0.0)).alias("sum_second"))


EFFORT = VISITS + ", " + SMALL + ", fl AS (SELECT CAST(route // 32 AS INTEGER) AS row, CAST(route % 32 AS INTEGER) AS col, year, coalesce(n, 0) AS n FROM vis LEFT JOIN cnt USING (visit))"


@query("A6_visits_and_counts", EFFORT + " SELECT row, col, CAST(sum(n) AS BIGINT) AS total, count(*) AS visits FROM fl WHERE year BETWEEN 1997 AND 1999 GROUP BY ALL")
def _(v):
    return fine_cell(filled(v)).where("year BETWEEN 1997 AND 1999").groupBy("row", "col").agg(F.sum("n").alias("total"), F.count("*").alias("visits"))


@query("A7_mean_observation", EFFORT + " SELECT row, col, year, avg(n) AS mean_n FROM fl GROUP BY row, col, year UNION ALL SELECT row, col, NULL, avg(n) FROM fl GROUP BY row, col")
def _(v):
    cells = fine_cell(filled(v))
    return cells.groupingSets([["row", "col", "year"], ["row", "col"]], "row", "col", "year").agg(F.avg("n").alias("mean_n"))


@query("A8_observed_vs_expected", "SELECT a.year, sum(d.juv + d.adult) AS expected, R6(sum(a.v)) AS observed FROM v_annual a JOIN v_density d USING (row, col, year) WHERE a.v IS NOT NULL GROUP BY a.year HAVING sum(a.v) > 0")
def _(v):
    j = v.annual().where("v IS NOT NULL").join(v.density(), ["row", "col", "year"])
    return j.groupBy("year").agg(F.sum(F.col("juv") + F.col("adult")).alias("expected"), r6(F.sum("v")).alias("observed")).where("observed > 0")


@query("A9_centroid_trajectory", "SELECT row AS year, dim, R6(avg(zv)) AS mean_z FROM v_zlong GROUP BY ALL")
def _(v):
    return v.zlong().groupBy(F.col("row").alias("year"), "dim").agg(r6(F.avg("zv")).alias("mean_z"))


@query("A10_hovmoller", "SELECT year, row, round(avg(v), 8) AS mean_v FROM v_annual GROUP BY ALL")
def _(v):
    return v.annual().groupBy("year", "row").agg(F.round(F.avg("v"), 8).alias("mean_v"))


@query("A11_rate_trends", f"""SELECT year, R6(avg(Sa)) AS Sa, R6(avg(Sj)) AS Sj, R6(avg(Fmax)) AS Fmax, R6({R0.replace('Sa', 'avg(Sa)').replace('Fmax', 'avg(Fmax)').replace('Sj', 'avg(Sj)')}) AS R0, R6(sum(K) / 1000) AS K_total FROM v_rates GROUP BY year""")
def _(v):
    means = v.rates().groupBy("year").agg(*[F.avg(c).alias(c) for c in ("Sa", "Sj", "Fmax")], (F.sum("K") / 1000).alias("K_total"))
    return means.select("year", *[r6(F.col(c)).alias(c) for c in ("Sa", "Sj", "Fmax", "K_total")], r6(r0()).alias("R0"))


@query("A12_epoch_means", """e AS (SELECT row, col, avg(CASE WHEN year BETWEEN 1995 AND 1996 THEN K END) AS early, avg(CASE WHEN year BETWEEN 2000 AND 2001 THEN K END) AS late FROM v_rates GROUP BY ALL),
    b AS (SELECT row, col, max(m) AS best_q FROM (SELECT row, col, kernel, avg(Q) AS m FROM v_q GROUP BY ALL) GROUP BY ALL) SELECT row, col, early, late, R6(best_q) AS best_q FROM e JOIN b USING (row, col)""")
def _(v):
    # cell-years are dealt by cell once; means, maxima and the join all keep to a cell
    e = temporal.epoch_means(v.deal(v.rates(), "row", "col"), ["row", "col"], "year", "K", {"early": (1995, 1996), "late": (2000, 2001)})
    best = v.q_long("row", "col").groupBy("row", "col", "kernel").agg(F.avg("Q").alias("m")).groupBy("row", "col").agg(r6(F.max("m")).alias("best_q"))
    return e.join(best, ["row", "col"])


@query("A13_juvenile_fraction", """SELECT year, sum(juv) / sum(juv + adult) AS fraction, count(CASE WHEN juv + adult > 0.01 THEN 1 END) AS n_cells FROM v_density GROUP BY year""")
def _(v):
    total = F.col("juv") + F.col("adult")
    return v.density().groupBy("year").agg((F.sum("juv") / F.sum(total)).alias("fraction"), F.count_if(total > 0.01).alias("n_cells"))


@query("A13b_juvenile_fraction_cells", "SELECT row, col, year, juv / (juv + adult) AS fraction FROM v_density WHERE juv + adult > 0.01 AND year IN (1996, 1999, 2001)")
def _(v):
    total = F.col("juv") + F.col("adult")
    return v.density().where((total > 0.01) & F.col("year").isin(1996, 1999, 2001)).select("row", "col", "year", (F.col("juv") / total).alias("fraction"))


@query("A14_sampling_density", EFFORT + ", s AS (SELECT DISTINCT row, col FROM fl) SELECT (SELECT count(*) FROM s) AS n_sites, (SELECT count(*) FROM v_land) AS n_land, (SELECT count(*) FROM s) / (SELECT count(*) FROM v_land)::DOUBLE AS density")
def _(v):
    return survey.sampling_density(fine_cell(filled(v)), v.land())


@query("A15_positive_summary", """SELECT count(CASE WHEN s > 0 THEN 1 END) AS n_pos, count(*) AS n, min(CASE WHEN s > 0 THEN s END) AS lo, max(s) AS hi, R6(avg(CASE WHEN s > 0 THEN s END)) AS mean_pos,
    quantile_cont(CASE WHEN s > 0 THEN s END, 0.5) AS median_pos FROM (SELECT v - 25 AS s FROM v_land_field)""")
def _(v):
    s = v.land_field().select((F.col("v") - 25).alias("s"))
    pos = F.when(F.col("s") > 0, F.col("s"))
    median = ordering.exact_quantiles(s.where("s > 0"), "s", [0.5], ["median_pos"]).scalar()
    return s.agg(F.count_if(F.col("s") > 0).alias("n_pos"), F.count("*").alias("n"), F.min(pos).alias("lo"), F.max("s").alias("hi"), r6(F.avg(pos)).alias("mean_pos")).withColumn("median_pos", median)


@query("A16_nodata_profile", """SELECT year * 100 + month AS layer, count(*) AS total, count(*) - count(value) AS missing, count(value) AS valid, (count(*) - count(value)) / count(*)::DOUBLE AS fraction, min(value) AS min, max(value) AS max FROM v_cells GROUP BY 1""")
def _(v):
    return stats.nodata_profile(v.cells().withColumn("layer", F.col("year") * 100 + F.col("month")), "layer", "value")


@query("A17_class_report", """SELECT CASE WHEN v > 30 THEN 'core' WHEN v > 20 THEN 'margin' ELSE 'empty' END AS class, year, count(*) AS n, count(v) AS n_real FROM v_annual GROUP BY ALL""")
def _(v):
    cls = F.when(F.col("v") > 30, "core").when(F.col("v") > 20, "margin").otherwise("empty")
    return v.annual().groupBy(cls.alias("class"), "year").agg(F.count("*").alias("n"), F.count("v").alias("n_real"))


@query("A18_histogram", """SELECT CAST(least(floor((v - 1) / 49.0::DOUBLE * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM v_annual WHERE v IS NOT NULL GROUP BY 1""")
def _(v):
    return stats.histogram(v.annual(), "v", 1, 50, 20)


@query("A19_histogram_2d", """SELECT CAST(least(floor((a.v - 1) / 49.0::DOUBLE * 12), 11) AS INTEGER) AS bx, CAST(least(floor((f.v - 1) / 49.0::DOUBLE * 12), 11) AS INTEGER) AS "by", count(*) AS n FROM v_annual a JOIN v_field f USING (row, col) WHERE a.v IS NOT NULL GROUP BY ALL""")
def _(v):
    j = v.annual().join(v.field().withColumnRenamed("v", "f"), ["row", "col"])
    return stats.histogram2d(j, "v", "f", (1, 50), (1, 50), 12)


@query("A20_contribution_distribution", B_SQL + """, c AS (SELECT unnest(range(64))::INTEGER AS feature, unnest(z) * unnest(bs) AS x FROM v_z, b) SELECT feature, R6(quantile_cont(x, 0.25)) AS q25, R6(quantile_cont(x, 0.5)) AS q50, R6(quantile_cont(x, 0.75)) AS q75, R6(avg(x)) AS mean FROM c GROUP BY feature""")
def _(v):
    c = v.z().select(F.posexplode(rates.contributions(F.col("z"), BETA_S)).alias("feature", "x"))
    q = ordering.exact_quantiles(c, "x", [0.25, 0.5, 0.75], ["q25", "q50", "q75"], group=["feature"])
    return q.join(c.groupBy("feature").agg(F.avg("x").alias("mean")), "feature").select("feature", *[r6(F.col(n)).alias(n) for n in ("q25", "q50", "q75", "mean")])


@query("A21_colour_bounds", """SELECT dim, R6(quantile_cont(zv, 0.02)) AS lo, R6(quantile_cont(zv, 0.98)) AS hi, R6(quantile_cont(abs(zv), 0.98)) AS abs_hi FROM v_zlong GROUP BY dim""")
def _(v):
    z = v.zlong()
    signed = ordering.exact_quantiles(z, "zv", [0.02, 0.98], ["lo", "hi"], group=["dim"])
    size = ordering.exact_quantiles(z.withColumn("zv", F.abs("zv")), "zv", [0.98], ["abs_hi"], group=["dim"])
    return signed.join(size, "dim").select("dim", *[r6(F.col(n)).alias(n) for n in ("lo", "hi", "abs_hi")])


@query("A22_pearson", """j AS (SELECT a.v AS x, f.v AS y FROM v_annual a JOIN v_field f USING (row, col) WHERE a.v IS NOT NULL AND f.v IS NOT NULL) SELECT 'all' AS part, count(*) AS n, R6(corr(x, y)) AS r FROM j
    UNION ALL SELECT 'few', count(*), CASE WHEN count(*) >= 100 THEN R6(corr(x, y)) END FROM j WHERE x >= 49 AND y >= 35""")
def _(v):
    j = v.annual().join(v.field().withColumnRenamed("v", "f"), ["row", "col"])
    every = stats.pearson(j, "v", "f").withColumn("part", F.lit("all"))
    few = stats.pearson(j.where("v >= 49 AND f >= 35"), "v", "f").withColumn("part", F.lit("few"))
    return every.unionByName(few).select("part", "n", r6(F.col("r")).alias("r"))


@query("A23_spearman_matrix", """p AS (SELECT unnest(['size', 'size', 'disc', 'disc']) AS a, unnest(['price', 'qty', 'price', 'qty']) AS b, unnest([size, size, disc, disc]) AS x, unnest([price, qty, price, qty]) AS y FROM v_traits),
    k AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM k)
    SELECT a, b, R6(corr(rx, ry)) AS rho FROM r GROUP BY a, b""")
def _(v):
    m = stats.spearman_matrix(v.traits(), ["size", "disc"], ["price", "qty"])
    return m.select("a", "b", r6(F.col("rho")).alias("rho"))


@query("A24_mantel", """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(vec_id * 37 % 101 AS DOUBLE) AS y FROM embeddings), p AS (SELECT list_dot_product(a.x, b.x) AS k, 1 - abs(a.y - b.y) / 100 AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)
    SELECT (SELECT count(*) FROM e) AS n, R6(corr(k, s)) AS similarity_r, R6(corr(-k, 1 - s)) AS distance_r FROM p""")
def _(v):
    e = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.pmod(F.col("vec_id") * 37, F.lit(101)).cast("double").alias("y"))
    m = stats.mantel(e, "x", "y", "vec_id")
    return m.select("n", r6(F.col("similarity_r")).alias("similarity_r"), r6(F.col("distance_r")).alias("distance_r"))


@query("A25_trend_line", "SELECT R6(regr_slope(a.v, f.v)) AS slope, R6(regr_intercept(a.v, f.v)) AS intercept FROM v_annual a JOIN v_field f USING (row, col)")
def _(v):
    t = stats.trend_line(v.annual().join(v.field().withColumnRenamed("v", "f"), ["row", "col"]), "f", "v")
    return t.select(r6(F.col("slope")).alias("slope"), r6(F.col("intercept")).alias("intercept"))


@query("A26_rmse_r2", "SELECT R6(sqrt(avg((a.v - f.v) * (a.v - f.v)))) AS rmse, R6(1 - var_pop(a.v - f.v) / var_pop(a.v)) AS r2 FROM v_annual a JOIN v_field f USING (row, col) WHERE a.v IS NOT NULL")
def _(v):
    rmse, r2 = stats.regression_fit(F.col("v"), F.col("f"))
    return v.annual().where("v IS NOT NULL").join(v.field().withColumnRenamed("v", "f"), ["row", "col"]).agg(r6(rmse).alias("rmse"), r6(r2).alias("r2"))


@query("A27_count_scores", """o AS (SELECT n::DOUBLE AS k, 1 + (visit % 90)::DOUBLE AS mu FROM v_counts WHERE species = 'SMALL')
    SELECT R6(sum(k * ln(mu) - mu) / count(*)) AS poisson, R6(sum(lgamma(k + 2.5) - lgamma(2.5) - lgamma(k + 1) + 2.5 * ln(2.5 / (2.5 + mu)) + k * ln(mu / (2.5 + mu))) / count(*)) AS negative_binomial FROM o""")
def _(v):
    o = v.counts().where("species = 'SMALL'").select(F.col("n").cast("double").alias("k"), (1 + F.pmod("visit", F.lit(90)).cast("double")).alias("mu"))
    return o.agg(r6(stats.poisson_score(F.col("k"), F.col("mu")) / F.count("*")).alias("poisson"),
                 r6(stats.negative_binomial_score(F.col("k"), F.col("mu"), 2.5) / F.count("*")).alias("negative_binomial"))


# -- community statistics -----------------------------------------------------------------

CENT = """az AS (SELECT a.species, a.week, e.x AS e, a.x, e.dim FROM v_abund a JOIN (SELECT CAST(vec_id AS INTEGER) AS cell, CAST(d AS INTEGER) AS dim, CAST(embedding[d + 1] AS DOUBLE) AS x FROM embeddings, range(64) AS g(d)) e ON e.cell = a.cell),
    wk AS (SELECT species, week, dim, sum(x * e) AS zsum, sum(x * e) / (sum(x) + 1e-9) AS zmean FROM az GROUP BY ALL)"""


def latent(v):
    return v.table("embeddings").select(F.col("vec_id").cast("int").alias("cell"), F.col("embedding").cast("array<double>").alias("z"))


def centroids(v):
    """(species, week, dim, zsum, zmean): one pass, 64 sums per group."""
    j = v.abund().join(latent(v), "cell")
    sums = j.groupBy("species", "week").agg(F.sum("x").alias("_s"), F.array(*[F.sum(F.col("x") * F.get("z", F.lit(d))) for d in range(64)]).alias("_z"))
    return sums.select("species", "week", F.posexplode("_z").alias("dim", "zsum"), "_s").select(
        "species", "week", "dim", "zsum", (F.col("zsum") / (F.col("_s") + 1e-9)).alias("zmean"))


@query("A31_weighted_centroids", CENT + " SELECT species, dim, R6(avg(zsum)) AS annual_sum, R6(avg(zmean)) AS annual_mean FROM wk GROUP BY ALL")
def _(v):
    return centroids(v).groupBy("species", "dim").agg(r6(F.avg("zsum")).alias("annual_sum"), r6(F.avg("zmean")).alias("annual_mean"))


SIM = CENT + f""", bb AS (SELECT {BETA_S}::DOUBLE[] AS bs), dir AS (SELECT (generate_subscripts(bs, 1) - 1) AS dim, unnest(bs) / (sqrt(list_dot_product(bs, bs)) + 1e-9) AS b FROM bb),
    si AS (SELECT species, week, sum(zsum * b) / (sqrt(sum(zsum * zsum)) + 1e-9) AS sim FROM wk JOIN dir USING (dim) GROUP BY ALL)"""


def weekly_similarity(v):
    j = v.abund().join(latent(v), "cell")
    sums = j.groupBy("species", "week").agg(F.array(*[F.sum(F.col("x") * F.get("z", F.lit(d))) for d in range(64)]).alias("w"))
    return sums.select("species", "week", similarity.cosine(F.col("w"), BETA_S).alias("sim"))


@query("A32_absolute_similarity_by_date", SIM + " SELECT week, R6(avg(abs(sim))) AS abs_sim, R6(avg(sim)) AS mean_sim FROM si GROUP BY week")
def _(v):
    return weekly_similarity(v).groupBy("week").agg(r6(F.avg(F.abs("sim"))).alias("abs_sim"), r6(F.avg("sim")).alias("mean_sim"))


@query("K12_cosine_to_direction", SIM + " SELECT species, week, R6(sim) AS sim FROM si")
def _(v):
    return weekly_similarity(v).select("species", "week", r6(F.col("sim")).alias("sim"))


@query("K12b_annual_cosine", SIM + ", an AS (SELECT species, dim, avg(zsum) AS zs FROM wk GROUP BY ALL) SELECT species, R6(sum(zs * b) / (sqrt(sum(zs * zs)) + 1e-9)) AS sim FROM an JOIN dir USING (dim) GROUP BY species")
def _(v):
    j = v.abund().join(latent(v), "cell")
    weekly = j.groupBy("species", "week").agg(*[F.sum(F.col("x") * F.get("z", F.lit(d))).alias(f"z{d}") for d in range(64)])
    annual = weekly.groupBy("species").agg(F.array(*[F.avg(f"z{d}") for d in range(64)]).alias("w"))
    return annual.select("species", r6(similarity.cosine(F.col("w"), BETA_S)).alias("sim"))


LOAD = """ee AS (SELECT CAST(vec_id AS INTEGER) AS cell, CAST(embedding AS DOUBLE[]) AS z FROM embeddings), ok AS (SELECT DISTINCT cell FROM v_abund SEMI JOIN ee USING (cell)),
    n AS (SELECT count(*) AS n FROM ok), zz AS (SELECT cell, CAST(unnest(range(64)) AS INTEGER) AS dim, unnest(z) AS zv FROM ee SEMI JOIN ok USING (cell)), zs AS (SELECT dim, avg(zv) AS m, stddev_pop(zv) AS s FROM zz GROUP BY dim),
    es AS (SELECT species, week, sum(x) / any_value(n) AS em, sqrt(greatest(sum(x * x) / any_value(n) - pow(sum(x) / any_value(n), 2), 0)) AS sd FROM v_abund SEMI JOIN ok USING (cell), n GROUP BY ALL),
    ze AS (SELECT dim, species, week, sum(zv * x) / any_value(n) AS c FROM v_abund JOIN zz USING (cell), n GROUP BY ALL),
    lo AS (SELECT dim, species, week, (c - m * em) / ((s + 1e-9) * (sd + 1e-9)) AS loading FROM ze JOIN zs USING (dim) JOIN es USING (species, week))"""


def load(v):
    return stats.loadings(latent(v), v.abund(), "cell", 64)


@query("A33_loadings", LOAD + " SELECT dim, species, week, R6(loading) AS loading FROM lo")
def _(v):
    return load(v).select("dim", "species", "week", r6(F.col("loading")).alias("loading"))


@query("A34_loading_summaries", LOAD + """ SELECT 'week' AS axis, dim, CAST(week AS VARCHAR) AS item, R6(avg(abs(loading))) AS abs_mean, R6(avg(loading)) AS mean FROM lo GROUP BY dim, week
    UNION ALL SELECT 'species', dim, species, R6(avg(abs(loading))), R6(avg(loading)) FROM lo GROUP BY dim, species""")
def _(v):
    out = stats.loading_summaries(load(v))
    return out.select("axis", "dim", "item", r6(F.col("abs_mean")).alias("abs_mean"), r6(F.col("mean")).alias("mean"))


@query("A35_profile_correlation", LOAD + """, sp AS (SELECT dim, species, avg(loading) AS x FROM lo GROUP BY ALL) SELECT a.species AS a, b.species AS b, R6(coalesce(corr(a.x, b.x), 0)) AS r FROM sp a JOIN sp b USING (dim) WHERE a.species <= b.species GROUP BY ALL""")
def _(v):
    profile = load(v).groupBy("dim", "species").agg(F.avg("loading").alias("x"))
    return stats.profile_correlation(profile, "species", "dim", "x").select("a", "b", r6(F.col("r")).alias("r"))


@query("A35b_week_correlation", LOAD + """, wk2 AS (SELECT dim, week, avg(loading) AS x FROM lo GROUP BY ALL) SELECT a.week AS a, b.week AS b, R6(coalesce(corr(a.x, b.x), 0)) AS r FROM wk2 a JOIN wk2 b USING (dim) WHERE a.week <= b.week GROUP BY ALL""")
def _(v):
    profile = load(v).groupBy("dim", "week").agg(F.avg("loading").alias("x"))
    return stats.profile_correlation(profile, "week", "dim", "x").select("a", "b", r6(F.col("r")).alias("r"))


GRAM = "gm AS (SELECT i, j, sum(z[i + 1] * z[j + 1]) AS g FROM v_z, range(64) AS a(i), range(64) AS b(j) GROUP BY ALL)"


@query("A36_effective_rank", GRAM + " SELECT R6(pow(sum(CASE WHEN i = j THEN g END), 2) / sum(g * g)) AS effective_rank FROM gm")
def _(v):
    return stats.effective_rank(v.z(), "z").select(r6(F.col("effective_rank")).alias("effective_rank"))


# the sum of singular values is the trace of the root of the Gram matrix, found by coupled Newton steps
ROOT = GRAM + """, gl AS MATERIALIZED (SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(g ORDER BY j) AS r FROM gm GROUP BY i)), f AS MATERIALIZED (SELECT sqrt(list_sum(list_transform(g, lambda r: list_dot_product(r, r)))) AS f FROM gl),
    n AS (SELECT 0 AS it, list_transform(g, lambda r: list_transform(r, lambda x: x / f)) AS y, list_transform(g, lambda r, i: list_transform(r, lambda x, j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS z FROM gl, f
        UNION ALL SELECT it + 1, list_transform(y, lambda r: list_transform(t, lambda c: list_dot_product(r, c))), list_transform(t, lambda r: list_transform(z, lambda c: list_dot_product(r, c)))
        FROM (SELECT it, y, z, list_transform(z, lambda r, i: list_transform(y, lambda c, j: 0.5 * (CASE WHEN i = j THEN 3 ELSE 0 END - list_dot_product(r, c)))) AS t FROM n WHERE it < 40)),
    sr AS (SELECT list_sum(list_transform(y, lambda r, i: r[i])) * sqrt(f) AS s FROM n, f WHERE it = 40)"""


@query("A36b_participation_rank", ROOT + " SELECT (SELECT count(*) FROM v_z) AS n, R6(s * s / list_sum(list_transform(g, lambda r, i: r[i]))) AS participation_rank FROM sr, gl")
def _(v):
    rank = stats.participation_rank(v.z(), "z", 64)
    return v.z().agg(F.count("*").alias("n")).withColumn("participation_rank", r6(F.lit(rank)))


PAIRV = "zv AS (SELECT vec_id, z, list_transform(z, lambda x, i: x * (1 + (i % 3) / 8.0::DOUBLE)) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings)), pr AS (SELECT list_dot_product(a.z, b.z) AS kz, list_dot_product(a.e, b.e) AS k, a.vec_id AS i, b.vec_id AS j FROM zv a, zv b)"


def two_embeddings(v):
    z = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    return z.withColumn("e", F.transform("z", lambda x, i: x * (1 + ((i + 1) % 3) / 8.0)))


@query("A37_kernel_fidelity", PAIRV + " SELECT R6(sqrt(avg(pow(kz - k, 2)))) AS rmse, R6(sqrt(avg(pow(kz - k, 2))) / (sqrt(avg(k * k)) + 1e-8)) AS rmse_norm FROM pr")
def _(v):
    f = stats.linear_kernel_fidelity(two_embeddings(v), "z", "e")
    return f.select(r6(F.col("rmse")).alias("rmse"), r6(F.col("rmse_norm")).alias("rmse_norm"))


@query("A38_kernel_diagnostics", PAIRV + """ SELECT R6(sum(kz * k) / sqrt(sum(kz * kz) * sum(k * k))) AS alignment, R6(avg(CASE WHEN i = j THEN kz END)) AS diag_mean, R6(avg(CASE WHEN i <> j THEN kz END)) AS offdiag_mean,
    R6(avg(CASE WHEN i = j THEN sqrt(kz) END)) AS norm_mean, R6(stddev_pop(CASE WHEN i = j THEN sqrt(kz) END)) AS norm_sd FROM pr""")
def _(v):
    f = stats.linear_kernel_fidelity(two_embeddings(v), "z", "e")
    return f.select(*[r6(F.col(c)).alias(c) for c in ("alignment", "diag_mean", "offdiag_mean", "norm_mean", "norm_sd")])


# the kernels that a product of embeddings is held against, on sampled pairs
TRUTH = """a AS (SELECT CAST(embedding AS DOUBLE[]) AS z, row_number() OVER (ORDER BY md5('5|' || vec_id), vec_id) AS pair FROM embeddings), b AS (SELECT CAST(embedding AS DOUBLE[]) AS z, row_number() OVER (ORDER BY md5('6|' || vec_id), vec_id) AS pair FROM embeddings),
    p AS (SELECT list_dot_product(a.z, b.z) AS kz, pow(list_distance(a.z, b.z), 2) AS d2, list_sum(list_transform(list_zip(a.z, b.z), lambda q: least(abs(q[1]), abs(q[2])))) / list_sum(list_transform(list_zip(a.z, b.z), lambda q: greatest(abs(q[1]), abs(q[2])))) AS ru FROM a JOIN b USING (pair) WHERE pair <= 400),
    k AS (SELECT 'rbf' AS kind, kz, exp(-d2 / (2 * 0.8 * 0.8)) AS k FROM p UNION ALL SELECT 'rq', kz, pow(1 + d2 / (2 * 1.5 * 0.8 * 0.8), -1.5) FROM p UNION ALL SELECT 'ruzicka', kz, ru FROM p)"""


def fidelity(v):
    z = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    p = sampling.sample_pairs(z, "vec_id", 400, 5, ["z"])
    d2 = vectors.squared_distance(F.col("z_a"), F.col("z_b"))
    size_a, size_b = F.transform("z_a", F.abs), F.transform("z_b", F.abs)
    truth = {"rbf": similarity.rbf(d2, 0.8), "rq": similarity.rational_quadratic(d2, 0.8, 1.5), "ruzicka": vectors.ruzicka(size_a, size_b)}
    out = None
    for kind, k in truth.items():
        part = similarity.pair_errors(p, vectors.dot(F.col("z_a"), F.col("z_b")), k).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("A37b_kernel_fidelity_pairs", TRUTH + " SELECT kind, R6(sqrt(avg(pow(kz - k, 2)))) AS rmse, R6(sqrt(avg(pow(kz - k, 2))) / (sqrt(avg(k * k)) + 1e-8)) AS rmse_norm, R6(sum(kz * k) / sqrt(sum(kz * kz) * sum(k * k))) AS alignment FROM k GROUP BY kind")
def _(v):
    return fidelity(v).select("kind", *[r6(F.col(c)).alias(c) for c in ("rmse", "rmse_norm", "alignment")])


@query("A39_weighted_kernel_error", TRUTH + " SELECT kind, R6(avg(pow(kz - k, 2))) AS plain, R6(avg(abs(k) * pow(kz - k, 2))) AS weighted_abs, R6(avg(k * k * pow(kz - k, 2))) AS weighted_square FROM k GROUP BY kind")
def _(v):
    return fidelity(v).select("kind", *[r6(F.col(c)).alias(c) for c in ("plain", "weighted_abs", "weighted_square")])


@query("A40_orthogonality_error", GRAM + ", n AS (SELECT count(*) AS n FROM v_z) SELECT R6(avg(pow(g / n - CASE WHEN i = j THEN 1 ELSE 0 END, 2))) AS orthogonality_error FROM gm, n")
def _(v):
    return stats.orthogonality_error(v.z(), "z", 64).select(r6(F.col("orthogonality_error")).alias("orthogonality_error"))


@query("A42_latent_report", LOAD + """, s AS (SELECT dim, species, avg(loading) AS m FROM lo GROUP BY ALL), w AS (SELECT dim, week, avg(abs(loading)) AS m FROM lo GROUP BY ALL)
    SELECT dim, (SELECT string_agg(species, ', ' ORDER BY m DESC) FROM (SELECT species, m FROM s WHERE s.dim = d.dim ORDER BY m DESC LIMIT 3)) AS drivers, (SELECT string_agg(species, ', ' ORDER BY m) FROM (SELECT species, m FROM s WHERE s.dim = d.dim ORDER BY m LIMIT 3)) AS avoiders,
    (SELECT string_agg(week, ', ' ORDER BY m DESC) FROM (SELECT week, m FROM w WHERE w.dim = d.dim ORDER BY m DESC LIMIT 5)) AS top_weeks FROM (SELECT DISTINCT dim FROM lo) d""")
def _(v):
    return stats.latent_report(load(v))
