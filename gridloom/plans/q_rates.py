"""Rates, source-sink classes, bases and scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import links, ordering, vectors
from gridloom.operators import clean, grid, rates
from gridloom.plans.registry import query
from gridloom.plans.views import r6

DIM = 64
# Fixed coefficients of the test model, generated by rule so that both engines share them.
BETA_S = [((i * 7) % 11 - 5) / 8 for i in range(DIM)]
BETA_R = [((i * 5) % 13 - 6) / 8 for i in range(DIM)]
PARAMS = {"alpha_a": 0.5, "gamma_a": 1.25, "alpha_j": -0.5, "gamma_j": 1.5, "alpha_f": 1.0, "gamma_f": 0.75, "alpha_k": 2.0, "gamma_k": 0.5}
B_SQL = f"b AS (SELECT {BETA_S}::DOUBLE[] AS bs, {BETA_R}::DOUBLE[] AS br)"
HAB = B_SQL + ", hab AS (SELECT row, col, z, list_dot_product(z, bs) AS hs, list_dot_product(z, br) AS hr FROM v_z, b)"
RATES = "1 / (1 + exp(-(0.5 + 1.25 * {s}))) AS Sa, 1 / (1 + exp(-(-0.5 + 1.5 * {s}))) AS Sj, ln(1 + exp(1.0 + 0.75 * {r})) AS Fmax, ln(1 + exp(2.0 + 0.5 * {r})) AS K"
R0 = "Fmax * Sj / (1 - Sa + 1e-6)"


def habitat(v):
    z = F.col("z")
    return v.z().withColumns({"hs": vectors.dot(z, vectors.lit_array(BETA_S)), "hr": vectors.dot(z, vectors.lit_array(BETA_R))})


def r0(prefix=""):
    return rates.replacement_rate(F.col("Sa"), F.col("Sj"), F.col("Fmax"))


@query("P30_link_functions", """SELECT row, col, year, R6(1 / (1 + exp(-(v - 25) / 5))) AS sig, R6(ln(1 + exp((v - 25) / 5))) AS sp,
    R6(exp(v / 10)) AS ex, least(greatest(v - 25, -10), 10) AS clipped FROM v_annual WHERE v IS NOT NULL""")
def _(v):
    x = (F.col("v") - 25) / 5
    return v.annual().where("v IS NOT NULL").select(
        "row", "col", "year", r6(links.sigmoid(x)).alias("sig"), r6(links.softplus(x)).alias("sp"),
        r6(F.exp(F.col("v") / 10)).alias("ex"), links.clip(F.col("v") - 25, -10, 10).alias("clipped"),
    )


@query("P31_linear_projection", HAB + """, m AS (SELECT kernel, k, ((k * 3) % 5 - 2) / 4.0::DOUBLE AS w FROM (SELECT unnest(['n', 's', 'e', 'w']) AS kernel, unnest([0, 1, 2, 3]) AS k))
    SELECT row, col, kernel, R6(hs) AS hs, R6(hs * w) AS h_kernel FROM hab, m""")
def _(v):
    def scaled(w):
        return F.transform("z", lambda x: x * F.lit(w))

    shifted = F.explode(F.array(*[F.struct(F.lit(n).alias("kernel"), scaled(((k * 3) % 5 - 2) / 4).alias("zk")) for k, n in enumerate("nsew")]))
    return habitat(v).select("row", "col", "hs", shifted.alias("e")).select(
        "row", "col", "e.kernel", r6(F.col("hs")).alias("hs"), r6(vectors.dot(F.col("e.zk"), vectors.lit_array(BETA_S))).alias("h_kernel")
    )


@query("P32_demographic_rates", HAB + f", rt AS (SELECT row, col, hs, {RATES.format(s='hs', r='hr')} FROM hab) SELECT row, col, R6(Sa) AS Sa, R6(Sj) AS Sj, R6(Fmax) AS Fmax, R6(K) AS K, R6(1 / (1 + exp(-(-0.5 + 1.5 * hs * 0.5)))) AS Q FROM rt")
def _(v):
    h = habitat(v)
    cols = {**rates.demographic_rates(F.col("hs"), F.col("hr"), PARAMS), "Q": rates.journey_survival(F.col("hs") * 0.5, PARAMS)}
    return h.select("row", "col", *[r6(c).alias(n) for n, c in cols.items()])


# one weight for each of the 64 latent dimensions
L_R, L_K, L_S = ([((i * k) % 9 - 4) / 16 for i in range(64)] for k in (5, 7, 2))


@query("P32b_growth_rates", f"""SELECT row, col, R6(0.1 + list_dot_product(z, {L_R}::DOUBLE[])) AS r, R6(exp(1.5 + list_dot_product(z, {L_K}::DOUBLE[]))) AS K, R6(1 / (1 + exp(-(list_dot_product(z, {L_S}::DOUBLE[]) - 0.5)))) AS s FROM v_z""")
def _(v):
    p = {"r_mean": 0.1, "L_r": L_R, "K_mean": 1.5, "L_K": L_K, "l_surv": L_S, "threshold": -0.5}
    cols = rates.growth_rates(F.col("z"), p)
    return v.z().select("row", "col", *[r6(c).alias(n) for n, c in cols.items()])


@query("P33_additive_fields", """y AS (SELECT year, sum(value) / count(value) AS ty FROM v_cells GROUP BY year)
    SELECT row, col, year, R6(0.1 + f.v / 64 + coalesce(a.v, 0) / 128 + ty / 256) AS r, R6(exp(1.0 + f.v / 32 + coalesce(a.v, 0) / 64)) AS K
    FROM v_annual a JOIN v_field f USING (row, col) JOIN y USING (year) WHERE f.v IS NOT NULL""")
def _(v):
    static = v.field().where("v IS NOT NULL").select("row", "col", (F.col("v") / 64).alias("r_static"), (F.col("v") / 32).alias("k_static"))
    x = F.coalesce("v", F.lit(0.0))
    varying = v.annual().select("row", "col", "year", (x / 128).alias("r_vary"), (x / 64).alias("k_vary"))
    yearly = v.cells().groupBy("year").agg((F.avg("value") / 256).alias("r_year"))
    return rates_fields(static, varying, yearly)


def rates_fields(static, varying, yearly):
    joined = varying.join(static, ["row", "col"]).join(yearly, "year")
    r = F.lit(0.1) + F.col("r_static") + F.col("r_vary") + F.col("r_year")
    return joined.select("row", "col", "year", r6(r).alias("r"), r6(F.exp(F.lit(1.0) + F.col("k_static") + F.col("k_vary"))).alias("K"))


@query("P34_replacement_rate", f"SELECT row, col, year, R6({R0}) AS R0 FROM v_rates")
def _(v):
    return v.rates().select("row", "col", "year", r6(r0()).alias("R0"))


@query("P35_effective_growth", """SELECT row, col, year, kernel, R6(Fmax / 4 + ln(1 - 0.3 + 0.3 * Q + 1e-12)) AS r_eff, R6(Fmax / 4 + ln(greatest((1 - 0.5) + 0.5 * Sa, 1e-6))) AS r_phi FROM v_rates JOIN v_q USING (row, col, year)""")
def _(v):
    j = v.rates().join(v.q_long(), ["row", "col", "year"])
    r = F.col("Fmax") / 4
    return j.select("row", "col", "year", "kernel", r6(rates.effective_growth(r, F.lit(0.3), F.col("Q"))).alias("r_eff"),
                    r6(rates.migrant_growth(r, F.lit(0.5) + 0.5 * F.col("Sa"))).alias("r_phi"))


@query("P36_source_sink", f"SELECT year, CASE WHEN {R0} > 1.1 THEN 'source' WHEN {R0} < 0.9 THEN 'sink' ELSE 'marginal' END AS class, count(*) AS n, count(CASE WHEN {R0} > 1 THEN 1 END) AS n_source FROM v_rates GROUP BY ALL")
def _(v):
    return v.rates().groupBy("year", rates.source_sink(r0()).alias("class")).agg(F.count("*").alias("n"), F.count_if(r0() > 1).alias("n_source"))


@query("P37_four_way_class", """SELECT row, col, year, CASE WHEN Fmax > 1.5 AND K > 30 THEN 'both' WHEN Fmax > 1.5 THEN 'only_a' WHEN K > 30 THEN 'only_b' ELSE 'neither' END AS class
    FROM (SELECT row, col, year, Fmax, Sa * 60 AS K FROM v_rates)""")
def _(v):
    return v.rates().select("row", "col", "year", rates.four_way(F.col("Fmax") * 20, F.col("Sa") * 60, 30).alias("class"))


@query("P38_directional_delta", f"""m AS (SELECT row, col, kernel, avg(Q) AS Q FROM v_q GROUP BY ALL), rr AS (SELECT row, col, {R0.replace('Sa', 'avg(Sa)').replace('Fmax', 'avg(Fmax)').replace('Sj', 'avg(Sj)')} AS R0 FROM v_rates GROUP BY ALL),
    f AS (SELECT row, col, split_part(kernel, '_', 2) AS d, split_part(kernel, '_', 3) AS dist_bin, R0 * Q AS x FROM m JOIN rr USING (row, col)),
    p AS (SELECT row, col, dist_bin, max(CASE d WHEN 'EAST' THEN x END) AS e, max(CASE d WHEN 'WEST' THEN x END) AS w, max(CASE d WHEN 'NORTH' THEN x END) AS n, max(CASE d WHEN 'SOUTH' THEN x END) AS s FROM f GROUP BY ALL)
    SELECT row, col, dist_bin, R6(e) AS from_west, R6(w) AS from_east, R6(e - w) AS delta_we, R6(n - s) AS delta_sn FROM p""")
def _(v):
    q = v.q_long("row", "col").groupBy("row", "col", "kernel").agg(F.avg("Q").alias("Q"))
    means = v.deal(v.rates(), "row", "col").groupBy("row", "col").agg(*[F.avg(c).alias(c) for c in ("Sa", "Sj", "Fmax")]).select("row", "col", r0().alias("R0"))
    fit = q.join(means, ["row", "col"]).withColumn("fitness", F.col("R0") * F.col("Q"))
    return rates.directional_delta(fit, ["row", "col"]).select("row", "col", "dist_bin", *[r6(F.col(c)).alias(c) for c in ("from_west", "from_east", "delta_we", "delta_sn")])


ABLATE = HAB + f""", c AS (SELECT row, col, hs, hr, unnest(range(64)) AS feature, unnest(z) AS zi, unnest(bs) AS bsi, unnest(br) AS bri FROM hab, b),
    r1 AS (SELECT row, col, feature, {RATES.format(s='(hs - zi * bsi)', r='(hr - zi * bri)')} FROM c), r2 AS (SELECT row, col, {RATES.format(s='hs', r='hr')} FROM hab),
    d AS (SELECT r1.row, r1.col, CAST(feature AS INTEGER) AS feature, r1.Fmax * r1.Sj / (1 - r1.Sa + 1e-6) - r2.Fmax * r2.Sj / (1 - r2.Sa + 1e-6) AS delta FROM r1 JOIN r2 ON r1.row = r2.row AND r1.col = r2.col)"""


@query("P39_ablation", ABLATE + " SELECT row, col, feature, R6(delta) AS delta FROM d")
def _(v):
    a = rates.ablation(v.z(), ["row", "col"], "z", BETA_S, BETA_R, PARAMS)
    return a.select("row", "col", "feature", r6(F.col("delta")).alias("delta"))


@query("P39b_keystone", ABLATE + " SELECT row, col, arg_max(feature, abs(delta)) AS keystone FROM d GROUP BY row, col")
def _(v):
    return rates.keystone(rates.ablation(v.z(), ["row", "col"], "z", BETA_S, BETA_R, PARAMS), ["row", "col"])


@query("P40_limiting_feature", B_SQL + """, c AS (SELECT row, col, unnest(range(64)) AS i, unnest(z) * unnest(bs) AS x FROM v_z, b)
    SELECT row, col, CAST(arg_min(i, (x, i)) AS INTEGER) AS limiting, CAST(arg_max(i, (x, -i)) AS INTEGER) AS driving FROM c GROUP BY row, col""")
def _(v):
    c = rates.contributions(F.col("z"), BETA_S)
    return v.z().select("row", "col", c.alias("c")).select("row", "col", rates.limiting_feature(F.col("c")).alias("limiting"), rates.driving_feature(F.col("c")).alias("driving"))


N_T, N_S = 2, 1
WEIGHTS = [((i * 3) % 7 - 3) / 4 for i in range(len(grid.cosine_terms(N_T, N_S)))]
BASIS = """tm AS (SELECT (row_number() OVER (ORDER BY k, i, j) - 1)::INTEGER AS b, k, i, j FROM range(3) AS a(k), range(2) AS c(i), range(2) AS e(j) WHERE k + i + j > 0),
    h AS (SELECT max(row)::DOUBLE AS h FROM v_grid), ba AS (SELECT row, col, year, b, v, cos(k * pi() * (year - 1995) / 6.0::DOUBLE) * (cos(i * pi() * (row / h)) * cos(j * pi() * (col / 31.0::DOUBLE))) AS phi FROM v_annual SEMI JOIN v_land USING (row, col), tm, h)"""


def coords(v):
    h = v.grid().agg(F.max("row").cast("double")).scalar()
    return (F.col("year") - 1995) / 6.0, F.col("row") / h, F.col("col") / 31.0


@query("P42_cosine_basis", BASIS + " SELECT row, col, year, b, R6(phi) AS phi FROM ba")
def _(v):
    t, y, x = coords(v)
    cells = v.annual().select("row", "col", "year").join(v.land(), ["row", "col"], "left_semi")
    return grid.cosine_basis(cells, t, y, x, N_T, N_S).select("row", "col", "year", "b", r6(F.col("phi")).alias("phi"))


@query("P43_basis_projection", BASIS + """, p AS (SELECT row, col, year, sum(phi * ((b * 3) % 7 - 3) / 4.0::DOUBLE) AS s FROM ba GROUP BY ALL)
    SELECT year, R6(avg(s)) AS mean_field, R6(min(s)) AS low, R6(max(s)) AS high FROM p GROUP BY year""")
def _(v):
    t, y, x = coords(v)
    cells = v.annual().join(v.land(), ["row", "col"], "left_semi")
    field = grid.cosine_projection(cells, t, y, x, N_T, N_S, WEIGHTS, "s")
    return field.groupBy("year").agg(r6(F.avg("s")).alias("mean_field"), r6(F.min("s")).alias("low"), r6(F.max("s")).alias("high"))


@query("P44_signal_noise", BASIS + """, p AS (SELECT row, col, year, any_value(v) AS v, sum(phi * ((b * 3) % 7 - 3) / 4.0::DOUBLE) AS s FROM ba GROUP BY ALL)
    SELECT R6(stddev_pop(v / 10)) AS signal_sd, R6(stddev_pop(s)) AS noise_sd, R6(stddev_pop(v / 10) / stddev_pop(s)) AS ratio FROM p WHERE v IS NOT NULL""")
def _(v):
    t, y, x = coords(v)
    cells = v.annual().where("v IS NOT NULL").join(v.land(), ["row", "col"], "left_semi")
    field = grid.cosine_projection(cells, t, y, x, N_T, N_S, WEIGHTS, "s")
    a, b = F.stddev_pop(F.col("v") / 10), F.stddev_pop("s")
    return field.agg(r6(a).alias("signal_sd"), r6(b).alias("noise_sd"), r6(a / b).alias("ratio"))


@query("P45_unit_scale", """q AS (SELECT dim, quantile_cont(zv, 0.02) AS lo, quantile_cont(zv, 0.98) AS hi FROM v_zlong GROUP BY dim)
    SELECT row, col, dim, R6(least(1, greatest(0, (zv - lo) / (hi - lo)))) AS zv FROM v_zlong JOIN q USING (dim)""")
def _(v):
    bounds = ordering.exact_quantiles(v.zlong(), "zv", [0.02, 0.98], ["lo", "hi"], group=["dim"])
    return clean.scale_unit(v.zlong(), bounds, "dim", "zv").select("row", "col", "dim", r6(F.col("zv")).alias("zv"))


@query("P46_capped_density", """g AS (SELECT row, col, year, sum(value) AS n, count(*) AS visits FROM v_cells GROUP BY ALL)
    SELECT row, col, year, CASE WHEN visits >= 2 THEN least(1, greatest(0, n / visits / 50)) END AS density FROM g WHERE n IS NOT NULL""")
def _(v):
    g = v.cells().groupBy("row", "col", "year").agg(F.sum("value").alias("n"), F.count("*").alias("visits")).where("n IS NOT NULL")
    return g.select("row", "col", "year", rates.capped_density(F.col("n"), F.col("visits"), 50.0, 2).alias("density"))


@query("P47_log_residual", """SELECT row, col, R6(avg(ln(1 + a.v) - ln(1 + f.v))) AS residual FROM v_annual a JOIN v_field f USING (row, col) GROUP BY row, col""")
def _(v):
    pred = v.field().withColumnRenamed("v", "pred")
    joined = v.annual().withColumnRenamed("v", "obs").join(pred, ["row", "col"])
    return rates.log_residuals(joined).select("row", "col", r6(F.col("residual")).alias("residual"))


@query("P50_utility", """s AS (SELECT l_partkey AS part, avg(l_quantity) / 4 AS rank, count(*) / 30.0::DOUBLE AS rmse FROM lineitem GROUP BY 1)
    SELECT part, R6(CASE WHEN rmse > 0.95 OR rank < 2 THEN 0 ELSE rank * (1 - rmse) END) AS utility FROM s""")
def _(v):
    s = v.table("lineitem").groupBy(F.col("l_partkey").alias("part")).agg((F.avg("l_quantity") / 4).alias("rank"), (F.count("*") / 30.0).alias("rmse"))
    return s.select("part", r6(rates.utility(F.col("rank"), F.col("rmse"))).alias("utility"))
