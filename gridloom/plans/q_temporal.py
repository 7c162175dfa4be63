"""Ranks, time series, focal and kernel operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import ordering
from gridloom.operators import focal, temporal, traits
from gridloom.plans.registry import query
from gridloom.plans.views import r6


@query("W1_mean_rank", """r AS (SELECT part, size, price, disc FROM v_traits),
    a AS (SELECT part, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0::DOUBLE AS size_rank FROM r),
    c AS (SELECT part, rank() OVER (ORDER BY disc) + (count(*) OVER (PARTITION BY disc) - 1) / 2.0::DOUBLE AS disc_rank FROM r WHERE disc IS NOT NULL)
    SELECT part, size_rank, disc_rank, (size_rank + coalesce(disc_rank, 0)) / (CASE WHEN disc_rank IS NULL THEN 1 ELSE 2 END) AS mean_rank FROM a LEFT JOIN c USING (part)""")
def _(v):
    return traits.mean_rank(v.traits(), ["size", "disc"]).select("part", "size_rank", "disc_rank", "mean_rank")


PCT = "f AS (SELECT row, col, v - 25 AS s FROM v_land_field), n AS (SELECT count(*) - 1 AS n FROM f)"


def signed(v):
    return v.land_field().select("row", "col", (F.col("v") - 25).alias("s"))


@query("W2_signed_percentile", PCT + " SELECT row, col, (row_number() OVER (ORDER BY s, row, col) - 1) / n::DOUBLE AS pct FROM f, n")
def _(v):
    f = signed(v)
    ranked = ordering.row_numbers(f, ["s", "row", "col"], "rn")
    return ranked.withColumn("_n", f.agg((F.count("*") - 1).cast("double")).scalar()).select("row", "col", ((F.col("rn") - 1) / F.col("_n")).alias("pct"))


@query("W3_adaptive_support", PCT + """, t AS (SELECT median(abs(s)) + 0.5 * (quantile_cont(abs(s), 0.75) - quantile_cont(abs(s), 0.25)) AS t FROM f)
    SELECT row, col, abs(s) >= t AS supported, (row_number() OVER (ORDER BY abs(s), row, col) - 1) / n::DOUBLE AS alpha FROM f, n, t""")
def _(v):
    f = signed(v).withColumn("a", F.abs("s"))
    q = ordering.exact_quantiles(f, "a", [0.25, 0.5, 0.75], ["lo", "mid", "hi"])
    limit = q.select(F.col("mid") + 0.5 * (F.col("hi") - F.col("lo"))).scalar()
    ranked = ordering.row_numbers(f, ["a", "row", "col"], "rn").withColumn("_n", f.agg((F.count("*") - 1).cast("double")).scalar())
    return ranked.select("row", "col", (F.col("a") >= limit).alias("supported"), ((F.col("rn") - 1) / F.col("_n")).alias("alpha"))


EMA = """s AS (SELECT row, col, year, v, row_number() OVER (PARTITION BY row, col ORDER BY year) AS rn FROM v_annual),
    e AS (SELECT row, col, year, rn, v AS state FROM s WHERE rn = 1 UNION ALL
        SELECT s.row, s.col, s.year, s.rn, CASE WHEN s.v IS NULL THEN e.state WHEN e.state IS NULL THEN s.v ELSE (1 - exp(-0.1::DOUBLE)) * s.v + (1 - (1 - exp(-0.1::DOUBLE))) * e.state END
        FROM e JOIN s ON s.row = e.row AND s.col = e.col AND s.rn = e.rn + 1)"""


@query("W4_ema_state", EMA + " SELECT row, col, year, R6(state) AS state FROM e")
def _(v):
    return temporal.ema(v.annual(), ["row", "col"], "year", "v").select("row", "col", "year", r6(F.col("state")).alias("state"))


@query("W4b_ema_poisoned", EMA + """, d AS (SELECT row, col, min(year) AS dead FROM s WHERE v IS NULL GROUP BY ALL)
    SELECT e.row, e.col, e.year, CASE WHEN dead IS NULL OR e.year < dead THEN R6(state) END AS state FROM e LEFT JOIN d ON d.row = e.row AND d.col = e.col""")
def _(v):
    out = temporal.ema(v.annual(), ["row", "col"], "year", "v", nan_policy="reference")
    return out.select("row", "col", "year", r6(F.col("state")).alias("state"))


@query("W4c_ema_daily_series", """s AS (SELECT user_id, day, x, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM v_series),
    e AS (SELECT user_id, day, rn, x AS state FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.day, s.rn, (1 - exp(-0.1::DOUBLE)) * s.x + (1 - (1 - exp(-0.1::DOUBLE))) * e.state FROM e JOIN s ON s.user_id = e.user_id AND s.rn = e.rn + 1)
    SELECT user_id, day, R6(state) AS state FROM e""")
def _(v):
    s = v.series().withColumn("t", F.unix_date("day"))
    return temporal.ema(s, ["user_id"], "t", "x").select("user_id", F.date_from_unix_date(F.col("t").cast("int")).alias("day"), r6(F.col("state")).alias("state"))


@query("W5_bio_year", """d AS (SELECT l_returnflag AS var, row, col, value, month, year + CAST(month >= 8 AS INTEGER) AS bio_year FROM (SELECT l_returnflag, CAST(l_suppkey AS INTEGER) AS row, CAST(l_partkey % 32 AS INTEGER) AS col,
        CAST(year(l_shipdate) AS INTEGER) AS year, month(l_shipdate) AS month, l_quantity AS value FROM lineitem)),
    ok AS (SELECT bio_year FROM (SELECT DISTINCT bio_year, month, var FROM d) GROUP BY 1 HAVING count(*) = 36) SELECT row, col, bio_year, var, avg(value) AS value FROM d SEMI JOIN ok USING (bio_year) GROUP BY ALL""")
def _(v):
    d = v.table("lineitem").select(
        F.col("l_returnflag").alias("var"), F.col("l_suppkey").cast("int").alias("row"), F.pmod("l_partkey", F.lit(32)).cast("int").alias("col"),
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("value"),
    )
    return temporal.complete_bio_years(d, 36, "var").groupBy("row", "col", "bio_year", "var").agg(F.avg("value").alias("value"))


INTERP = """a AS (SELECT row, col, year, v FROM v_annual WHERE year IN (1996, 1998, 2000)), k AS (SELECT DISTINCT row, col FROM a), y AS (SELECT row, col, CAST(yy AS INTEGER) AS year FROM k, range(1995, 2002) AS g(yy)),
    l AS (SELECT row, col, list(struct_pack(t := year, x := v) ORDER BY year) FILTER (WHERE v IS NOT NULL) AS p FROM a GROUP BY ALL),
    j AS (SELECT y.row, y.col, y.year, p, len(p) AS n FROM y LEFT JOIN l USING (row, col)),
    s AS (SELECT row, col, year, n, p, CASE WHEN n < 2 THEN NULL WHEN n = 2 OR year <= p[2].t THEN p[1] ELSE p[2] END AS a, CASE WHEN n < 2 THEN NULL WHEN n = 2 OR year <= p[2].t THEN p[2] ELSE p[3] END AS b FROM j),
    i AS (SELECT row, col, year, CASE WHEN n = 1 THEN p[1].x WHEN n >= 2 THEN (1 - (year - a.t) / (b.t - a.t)::DOUBLE) * a.x + (year - a.t) / (b.t - a.t)::DOUBLE * b.x END AS v FROM s)"""


def interpolated(v):
    return temporal.linear_interpolate(v.annual().where("year IN (1996, 1998, 2000)"), ["row", "col"], "year", "v", 1995, 2001)


@query("W6_linear_interpolation", INTERP + " SELECT row, col, year, R6(v) AS v FROM i")
def _(v):
    return interpolated(v).select("row", "col", "year", r6(F.col("v")).alias("v"))


@query("W7_sorted_bands", """b AS (SELECT row, col // 4 AS blk, year, avg(v) AS v, col % 4 AS k FROM v_annual WHERE v IS NOT NULL GROUP BY ALL)
    SELECT row, CAST(blk AS INTEGER) AS blk, year, CAST(row_number() OVER (PARTITION BY row, blk, year ORDER BY v) AS INTEGER) AS band, v FROM b""")
def _(v):
    b = v.annual().where("v IS NOT NULL").withColumn("blk", F.floor(F.col("col") / 4).cast("int"))
    return temporal.sort_bands(b, ["row", "blk", "year"], "band", "v")


def gauss_sql(sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    return f"gw AS (SELECT d, exp(-0.5 * (d / {sigma}::DOUBLE) ** 2) / (SELECT sum(exp(-0.5 * (e / {sigma}::DOUBLE) ** 2)) FROM range(-{r}, {r + 1}) AS g2(e)) AS w FROM range(-{r}, {r + 1}) AS g(d))"


SMOOTH = gauss_sql(1.5) + ", sm AS (SELECT cell, species, CAST((week + d + 52) % 52 AS INTEGER) AS week, sum(w * x) AS x FROM v_abund, gw GROUP BY ALL)"


def smoothed(abund):
    return temporal.circular_smooth(abund, ["cell", "species"], "week", "x", 1.5)


@query("W8_circular_smoothing", SMOOTH + " SELECT cell, species, week, R6(x) AS x FROM sm")
def _(v):
    return smoothed(v.abund()).select("cell", "species", "week", r6(F.col("x")).alias("x"))


@query("W9_smoothed_hellinger", SMOOTH + ", t AS (SELECT cell, sum(x) AS t FROM sm GROUP BY cell) SELECT cell, species, R6(sum(h)) AS h_sum, R6(max(h)) AS h_max FROM (SELECT cell, species, sqrt(x / CASE WHEN t < 1e-9 THEN 1 ELSE t END) AS h FROM sm JOIN t USING (cell)) GROUP BY ALL")
def _(v):
    # smoothing, totals, their join and the last sums all keep to a cell: its weekly rows are dealt once
    h = temporal.hellinger(smoothed(v.deal(v.abund(), "cell")), "cell", "x")
    return h.groupBy("cell", "species").agg(r6(F.sum("x")).alias("h_sum"), r6(F.max("x")).alias("h_max"))


POOL = """g AS (SELECT row, col, year, sum(coalesce(value, 0)) AS n, count(*) AS visits FROM v_cells GROUP BY ALL), b AS (SELECT min(year) AS lo, max(year) AS hi FROM g),
    fr AS (SELECT c AS frame, CASE WHEN c + o < lo THEN 2 * lo - (c + o) WHEN c + o > hi THEN 2 * hi - (c + o) ELSE c + o END AS year, lo, hi FROM b, range(1995, 2002) AS g1(c), range(-2, 3) AS g2(o) WHERE c BETWEEN lo AND hi),
    po AS (SELECT row, col, CAST(frame AS INTEGER) AS frame, sum(n) AS n, sum(visits) AS visits FROM g JOIN (SELECT frame, least(hi, greatest(lo, year)) AS year FROM fr) f USING (year) GROUP BY ALL)"""


def pooled(v):
    obs = v.cells().select("row", "col", "year", F.coalesce("value", F.lit(0.0)).alias("n"), F.lit(1).cast("bigint").alias("visits"))
    return temporal.pooled_frames(obs, ["row", "col"], "year", 2, ["n", "visits"])


@query("W10_mirrored_pooling", POOL + " SELECT row, col, frame, n, CAST(visits AS BIGINT) AS visits FROM po")
def _(v):
    return pooled(v).select("row", "col", "frame", "n", "visits")


def blur_sql(source: str, values: list[str], layer: str, name: str, sigma: float) -> str:
    """Two one-dimensional passes by definition: gather from the reflected index."""
    def axis(src, dst, pos, size):
        other = "col" if pos == "row" else "row"
        sums = ", ".join(f"sum(w * {c}) AS {c}" for c in values)
        return f"""{dst} AS (SELECT {layer} t AS {pos}, {other}, {sums} FROM (SELECT t, d, w, CASE WHEN t + d < 0 THEN -1 - (t + d) WHEN t + d >= n THEN 2 * n - 1 - (t + d) ELSE t + d END AS src FROM (SELECT CAST(t AS INTEGER) AS t, n FROM {size}, range(100000) AS gg(t) WHERE t < n), gw) m
            JOIN {src} ON {src}.{pos} = m.src GROUP BY ALL)"""
    return f"hh AS (SELECT max(row) + 1 AS n FROM v_grid), ww AS (SELECT 32 AS n), {axis(source, name + '_1', 'row', 'hh')}, {axis(name + '_1', name, 'col', 'ww')}"


def shape(v):
    return v.grid().agg(F.max("row") + 1).scalar(), F.lit(32)


@query("W11_spatial_blur", gauss_sql(1.0) + ", src AS (SELECT row, col, sum(coalesce(value, 0)) AS n, count(*)::DOUBLE AS visits FROM v_cells GROUP BY ALL), " + blur_sql("src", ["n", "visits"], "", "bl", 1.0)
       + " SELECT row, col, R6(n) AS n, R6(visits) AS visits FROM bl")
def _(v):
    obs = v.cells().groupBy("row", "col").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("n"), F.count("*").cast("double").alias("visits"))
    return focal.blur(obs, ["n", "visits"], 1.0, *shape(v)).select("row", "col", r6(F.col("n")).alias("n"), r6(F.col("visits")).alias("visits"))


@query("W12_missing_aware_blur", gauss_sql(1.0) + ", src AS (SELECT row, col, year, v, 1.0::DOUBLE AS m FROM v_annual WHERE v IS NOT NULL), " + blur_sql("src", ["v", "m"], "year,", "bl", 1.0)
       + " SELECT row, col, year, R6(v / m) AS v FROM bl WHERE m > 0")
def _(v):
    return focal.missing_aware_blur(v.annual(), "v", 1.0, *shape(v), layers=["year"]).select("row", "col", "year", r6(F.col("v")).alias("v"))


@query("W12b_missing_aware_blur_constant", gauss_sql(1.0) + """, src AS (SELECT row, col, year, v, 1.0::DOUBLE AS m FROM v_annual WHERE v IS NOT NULL), sh AS (SELECT max(row) AS r FROM v_grid),
    bl AS (SELECT row + a.d AS row, col + b.d AS col, year, sum(a.w * b.w * v) AS v, sum(a.w * b.w * m) AS m FROM src, gw a, gw b GROUP BY ALL)
    SELECT row, col, year, R6(CASE WHEN m >= 1e-6 THEN v / (m + 1e-6) END) AS v FROM bl CROSS JOIN sh WHERE row BETWEEN 0 AND r AND col BETWEEN 0 AND 31""")
def _(v):
    out = focal.missing_aware_blur(v.annual(), "v", 1.0, *shape(v), layers=["year"], edges="constant", eps=1e-6)
    return out.select("row", "col", "year", r6(F.col("v")).alias("v"))


@query("W13_habitat_pull", """c AS (SELECT g.row, g.col, 1 - is_ocean AS land, coalesce(f.v, 0) AS est, 50.0::DOUBLE AS cap, coalesce(d.juv, 0) AS arr FROM v_grid g LEFT JOIN v_field f USING (row, col) LEFT JOIN (SELECT row, col, sum(juv) AS juv FROM v_density GROUP BY ALL) d USING (row, col)),
    s AS (SELECT *, land / (1 + exp(-5 * (cap - est) / cap)) AS vv FROM c),
    n AS (SELECT s.row, s.col, sum(o.vv) AS vs, sum(o.land) AS ls FROM s JOIN (SELECT row + dr AS row, col + dc AS col, vv, land FROM s, range(-2, 3) AS a(dr), range(-2, 3) AS b(dc)) o ON o.row = s.row AND o.col = s.col GROUP BY ALL)
    SELECT row, col, R6(arr * vv / (vs / (ls + 1e-6) + 1e-6)) AS mass FROM s JOIN n USING (row, col)""")
def _(v):
    juv = v.density().groupBy("row", "col").agg(F.sum("juv").alias("juv"))
    cells = v.grid().join(v.field(), ["row", "col"], "left").join(juv, ["row", "col"], "left").select(
        "row", "col", (1 - F.col("is_ocean")).alias("land"), F.coalesce("juv", F.lit(0.0)).alias("arriving"),
        F.coalesce("v", F.lit(0.0)).alias("established"), F.lit(50.0).alias("capacity"))
    return focal.habitat_pull(cells).select("row", "col", r6(F.col("mass")).alias("mass"))


@query("W14_local_volatility", """s AS (SELECT max(row) + 1 AS h FROM v_z), n AS (SELECT a.row, a.col, a.dim, a.zv AS x, u.zv AS u, d.zv AS d, l.zv AS l, r.zv AS r, h FROM v_zlong a CROSS JOIN s
        LEFT JOIN v_zlong u ON u.row = a.row - 1 AND u.col = a.col AND u.dim = a.dim LEFT JOIN v_zlong d ON d.row = a.row + 1 AND d.col = a.col AND d.dim = a.dim
        LEFT JOIN v_zlong l ON l.row = a.row AND l.col = a.col - 1 AND l.dim = a.dim LEFT JOIN v_zlong r ON r.row = a.row AND r.col = a.col + 1 AND r.dim = a.dim),
    g AS (SELECT row, col, dim, CASE WHEN row = 0 THEN d - x WHEN row = h - 1 THEN x - u ELSE (d - u) / 2 END AS gr, CASE WHEN col = 0 THEN r - x WHEN col = 24 THEN x - l ELSE (r - l) / 2 END AS gc FROM n)
    SELECT row, col, R6(sqrt(sum(coalesce(gr * gr + gc * gc, 0)) / 64)) AS volatility FROM g GROUP BY ALL""")
def _(v):
    rows = v.z().agg(F.max("row") + 1).scalar()
    return focal.volatility(v.zlong(), rows, F.lit(25), F.lit(64)).select("row", "col", r6(F.col("volatility")).alias("volatility"))


@query("W15_endpoint_change", """a AS (SELECT row, col, v FROM v_annual WHERE year = 1995), b AS (SELECT row, col, v FROM v_annual WHERE year = 2001)
    SELECT row, col, b.v - a.v AS delta, R6(pow(b.v, 0.1) - pow(a.v, 0.1)) AS delta_power FROM a JOIN b USING (row, col) WHERE a.v IS NOT NULL AND b.v IS NOT NULL""")
def _(v):
    annual = v.annual()
    last = temporal.latest_available(annual, "year", 2024)
    plain = temporal.endpoint_change(annual, ["row", "col"], "year", "v", 1995, last)
    power = temporal.endpoint_change(annual.withColumn("p", F.pow("v", F.lit(0.1))), ["row", "col"], "year", "p", 1995, last)
    return plain.join(power.withColumnRenamed("delta", "dp"), ["row", "col"]).select("row", "col", "delta", r6(F.col("dp")).alias("delta_power"))


@query("W15b_vector_turnover", """a AS (SELECT row, col, dim, zv FROM v_zlong), p AS (SELECT a.row, a.col, a.dim, a.zv AS z0, a.zv * (1 + ((row + dim) % 5) / 16.0::DOUBLE) AS z1 FROM a)
    SELECT row, col, R6(sqrt(sum((z1 - z0) * (z1 - z0)))) AS turnover FROM p GROUP BY ALL""")
def _(v):
    moved = F.col("zv") * (1 + F.pmod(F.col("row") + F.col("dim"), F.lit(5)) / 16.0)
    years = v.zlong().withColumn("year", F.lit(1980)).unionByName(v.zlong().withColumn("zv", moved).withColumn("year", F.lit(2023)))
    change = temporal.endpoint_change(years, ["row", "col", "dim"], "year", "zv", 1980, temporal.latest_available(years, "year", 2024))
    return change.groupBy("row", "col").agg(r6(F.sqrt(F.sum(F.col("delta") * F.col("delta")))).alias("turnover"))


@query("W16_epoch_delta", """SELECT row, col, R6(avg(CASE WHEN year BETWEEN 1999 AND 2001 THEN v END) - avg(CASE WHEN year BETWEEN 1995 AND 1997 THEN v END)) AS delta FROM v_annual GROUP BY ALL""")
def _(v):
    m = temporal.epoch_means(v.annual(), ["row", "col"], "year", "v", {"early": (1995, 1997), "late": (1999, 2001)})
    return m.select("row", "col", r6(F.col("late") - F.col("early")).alias("delta"))


@query("W17_period_anomaly", "m AS (SELECT year, avg(v) AS m FROM v_annual GROUP BY year) SELECT row, col, year, R6(v - m) AS anomaly FROM v_annual JOIN m USING (year)")
def _(v):
    return temporal.period_anomaly(v.annual(), "year", "v").select("row", "col", "year", r6(F.col("anomaly")).alias("anomaly"))


# -- kernels ------------------------------------------------------------------------

RADIUS, CELL, MEAN, SHAPE = 2, 16.0, 20.0, 1.0
SPLITS = [0.0, 30.0, 1e9]
# exp(-d/scale) with scale = mean * Gamma(2) / Gamma(3) = mean / 2
KER = f"""off AS (SELECT CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc, sqrt(dr * dr + dc * dc) * {CELL}::DOUBLE AS d FROM range(-2, 3) AS a(dr), range(-2, 3) AS b(dc)),
    base AS (SELECT dr, dc, d, exp(-d / 10.0::DOUBLE) / (SELECT sum(exp(-d / 10.0::DOUBLE)) FROM off) AS w FROM off)"""
DIRK = KER + """, dn AS (SELECT * FROM (VALUES ('to_NORTH', -pi() / 2), ('to_SOUTH', pi() / 2), ('to_EAST', 0.0), ('to_WEST', pi())) AS t(nm, bearing)),
    ang AS (SELECT base.*, nm, CASE WHEN dr = 0 AND dc = 0 THEN 0.25 ELSE pow(cos(least(abs((atan2(dr, dc) - bearing + pi() + 4 * pi()) % (2 * pi()) - pi()), pi() / 2)), 2) END AS wd FROM base, dn),
    ker AS (SELECT nm || '_0-30' AS kernel, dr, dc, w * wd * (1 - 1 / (1 + exp(-(4.0 / 32) * (d - 30)))) AS w FROM ang UNION ALL
        SELECT nm || '_30-1000000000', dr, dc, w * wd * (1 / (1 + exp(-(4.0 / 32) * (d - 30)))) FROM ang),
    kn AS (SELECT kernel, sum(w) AS mass FROM ker GROUP BY kernel)"""
POP = "pop AS (SELECT row, col, sum(juv) AS juv FROM v_density SEMI JOIN v_land USING (row, col) GROUP BY row, col)"
FRAC = "fr AS (SELECT l.row, l.col, k.kernel, greatest(sum(CASE WHEN t.row IS NOT NULL THEN w / mass ELSE 0 END), 1e-12) AS frac FROM v_land l CROSS JOIN ker k JOIN kn USING (kernel) LEFT JOIN v_land t ON t.row = l.row + dr AND t.col = l.col + dc GROUP BY ALL)"


def base():
    return focal.isotropic(RADIUS, CELL, MEAN, SHAPE)


def stack():
    return focal.directional(base(), SPLITS, CELL)


def population(v):
    return v.density().groupBy("row", "col").agg(F.sum("juv").alias("value")).join(v.land(), ["row", "col"], "left_semi")


@query("W18_directional_kernels", DIRK + ", " + POP + " SELECT kernel, R6(sum(juv * w) / 1000) AS sent, count(*) AS n FROM pop, ker WHERE juv > 0 GROUP BY kernel")
def _(v):
    table = F.explode(F.map_from_entries(F.array(*[
        F.struct(F.lit(k), F.array(*[F.lit(w) for _, _, w in o])) for k, o in stack().items()])))
    spread = population(v).where("value > 0").select("value", table.alias("kernel", "ws"))
    per = spread.select("kernel", F.aggregate("ws", F.lit(0.0), lambda a, w: a + w * F.col("value")).alias("m"), F.size("ws").alias("n"))
    return per.groupBy("kernel").agg(r6(F.sum("m") / 1000).alias("sent"), F.sum("n").alias("n"))


@query("W19_isotropic_kernel", KER + ", " + POP + " SELECT row + dr AS row, col + dc AS col, R6(sum(juv * w)) AS value FROM pop, base GROUP BY ALL")
def _(v):
    out = focal.apply_kernels(population(v), {"iso": base()})
    return out.select("row", "col", r6(F.col("value")).alias("value"))


@query("W20_kernel_apply", DIRK + ", " + POP + " SELECT kernel, row + dr AS row, col + dc AS col, R6(sum(juv * w)) AS value FROM pop, ker GROUP BY ALL")
def _(v):
    return focal.apply_kernels(population(v), stack()).select("kernel", "row", "col", r6(F.col("value")).alias("value"))


@query("W20b_kernel_apply_tiles", KER.replace("range(-2, 3)", "range(-9, 10)") + ", " + POP + " SELECT row + dr AS row, col + dc AS col, R6(sum(juv * w)) AS value FROM pop, base GROUP BY ALL")
def _(v):
    big = {"iso": focal.isotropic(9, CELL, MEAN, SHAPE)}
    return focal.apply_kernels(population(v), big).select("row", "col", r6(F.col("value")).alias("value"))


@query("W21_land_fraction", DIRK + ", " + FRAC + " SELECT kernel, row, col, R6(frac) AS frac FROM fr")
def _(v):
    return focal.land_fraction(v.land(), stack()).select("kernel", "row", "col", r6(F.col("frac")).alias("frac"))


QK = "qk AS (SELECT row, col, kernel, 0.25::DOUBLE + ((row * 3 + col + length(kernel)) % 8) / 16.0 AS Q FROM v_land, kn)"


def q_field(v):
    names = F.explode(F.array(*[F.lit(k) for k in stack()]))
    q = F.lit(0.25) + F.pmod(F.col("row") * 3 + F.col("col") + F.length("kernel"), F.lit(8)) / 16.0
    return v.land().select("row", "col", names.alias("kernel")).withColumn("Q", q)


@query("W22_directional_redistribution", DIRK + ", " + POP + ", " + FRAC + ", " + QK + """, st AS (SELECT kernel, pop.row + dr AS row, pop.col + dc AS col, sum(juv / (frac + 1e-6) * w) AS s FROM pop JOIN fr USING (row, col) JOIN ker USING (kernel) GROUP BY ALL)
    SELECT row, col, R6(sum(s * Q)) AS value FROM st JOIN qk USING (row, col, kernel) GROUP BY ALL""")
def _(v):
    out = focal.redistribute(population(v), v.land(), stack(), q_field(v))
    return out.select("row", "col", r6(F.col("value")).alias("value"))


@query("W23_directional_expectation", DIRK + """, s AS (SELECT row, col, coalesce(1 / (1 + exp(-0.25 * (v - 25))), 1.0) AS s FROM v_grid LEFT JOIN v_field USING (row, col)),
    cv AS (SELECT kernel, row + dr AS row, col + dc AS col, sum((s - 1) * w) AS q FROM s, ker GROUP BY ALL)
    SELECT kernel, row, col, R6(q + mass) AS q FROM cv JOIN kn USING (kernel) SEMI JOIN v_grid USING (row, col)""")
def _(v):
    survival = F.coalesce(1 / (1 + F.exp(-0.25 * (F.col("v") - 25))), F.lit(1.0))
    s = v.grid().join(v.field(), ["row", "col"], "left").select("row", "col", survival.alias("value"))
    return focal.directional_expectation(s, v.grid(), stack()).select("kernel", "row", "col", r6(F.col("value")).alias("q"))


# a kernel in a square of 64 cells, resampled to 64 * n / 20 cells a side: triangle weights of the width of a step, each output cell's summing to 1
STEPS, FRAME = 20, 64
PATH = f"""sz AS (SELECT CAST(n AS INTEGER) AS n, {FRAME} * n // {STEPS} AS m FROM range(1, {STEPS + 1}) AS g(n)),
    tri AS (SELECT n, m, i, j, greatest(0, 1 - abs((i + 0.5::DOUBLE) * {FRAME} / m - 0.5 - j) * m / {FRAME}::DOUBLE) AS t FROM sz, range({FRAME}) AS a(i), range({FRAME}) AS b(j) WHERE i < m),
    ax AS (SELECT n, CAST(i + ({FRAME} - m) // 2 - {FRAME // 2} AS INTEGER) AS o, CAST(j - {FRAME // 2} AS INTEGER) AS d, t / sum(t) OVER (PARTITION BY n, i) AS t FROM tri),
    sk AS (SELECT kernel, y.n, y.o AS dr, x.o AS dc, sum(w * y.t * x.t) AS w FROM ker JOIN (SELECT * FROM ax WHERE t > 0) y ON y.d = dr JOIN (SELECT * FROM ax WHERE t > 0) x ON x.d = dc AND x.n = y.n GROUP BY ALL),
    st AS (SELECT kernel, n, dr, dc, w * mass / sum(w) OVER (PARTITION BY kernel, n) AS w FROM sk JOIN kn USING (kernel) WHERE w <> 0)"""


@query("W24_path_integration", DIRK + ", " + PATH + f""",
    num AS (SELECT kernel, n, year, f.row + dr AS row, f.col + dc AS col, sum(w * coalesce(v, 0)) AS s FROM (SELECT * FROM v_annual SEMI JOIN v_land USING (row, col)) f, st GROUP BY ALL),
    den AS (SELECT kernel, n, l.row + dr AS row, l.col + dc AS col, sum(w) AS s FROM v_land l, st GROUP BY ALL)
    SELECT kernel, year, row, col, R6(sum(num.s / greatest(den.s, 1e-6)) / {STEPS}) AS v FROM num JOIN den USING (kernel, n, row, col) SEMI JOIN v_land USING (row, col) GROUP BY ALL""")
def _(v):
    out = focal.path_integral(v.annual(), v.land(), stack(), STEPS, ["v"], ["year"], FRAME)
    return out.select("kernel", "year", "row", "col", r6(F.col("v")).alias("v"))


@query("W25_outgoing_risk", DIRK + ", " + FRAC + ", " + QK + """, pl AS (SELECT kernel, q.row - dr AS row, q.col - dc AS col, sum(Q * w) AS s FROM qk q JOIN ker USING (kernel) GROUP BY ALL)
    SELECT row, col, R6(1 - avg(coalesce(s, 0) / (frac + 1e-6))) AS risk FROM fr LEFT JOIN pl USING (kernel, row, col) GROUP BY ALL""")
def _(v):
    return focal.outgoing_risk(q_field(v), v.land(), stack()).select("row", "col", r6(F.col("risk")).alias("risk"))


@query("W25b_outgoing_risk_summed", DIRK + ", " + QK + """, hh AS (SELECT max(row) AS r, max(col) AS c FROM v_grid), mo AS (SELECT g.row, g.col, 1 - avg(coalesce(Q, 0)) AS m FROM v_grid g CROSS JOIN kn k LEFT JOIN qk ON qk.row = g.row AND qk.col = g.col AND qk.kernel = k.kernel GROUP BY ALL),
    su AS (SELECT dr, dc, sum(w) AS w FROM ker GROUP BY ALL)
    SELECT g.row, g.col, R6(sum(w * m)) AS risk FROM v_grid g CROSS JOIN hh CROSS JOIN su JOIN mo ON mo.row = CASE WHEN g.row - dr BETWEEN 0 AND r THEN g.row - dr ELSE r END AND mo.col = CASE WHEN g.col - dc BETWEEN 0 AND c THEN g.col - dc ELSE c END GROUP BY ALL""")
def _(v):
    names = F.explode(F.array(*[F.lit(k) for k in stack()])).alias("kernel")
    everywhere = v.grid().select("row", "col", names).join(q_field(v).hint("merge"), ["row", "col", "kernel"], "left").fillna(0.0, subset=["Q"])
    size = v.grid().agg(F.max("row") + 1).scalar(), v.grid().agg(F.max("col") + 1).scalar()
    return focal.outgoing_risk_summed(everywhere, stack(), *size).select("row", "col", r6(F.col("risk")).alias("risk"))



@query("A28_radial_profile", KER + """, m AS (SELECT CAST(floor(sqrt(dr * dr + dc * dc)) AS INTEGER) AS ring, avg(juv * w) AS mean_w FROM v_density SEMI JOIN v_land USING (row, col), base GROUP BY ALL)
    SELECT ring, R6(mean_w) AS mean_w, R6(mean_w / (SELECT max(mean_w) FROM m)) AS rel_w FROM m""")
def _(v):
    pop = v.density().join(v.land(), ["row", "col"], "left_semi").select("juv")
    table = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(w).alias("w")) for dr, dc, w in base()]))
    sent = pop.select("juv", table.alias("k")).select(F.lit("iso").alias("kernel"), "k.dr", "k.dc", (F.col("k.w") * F.col("juv")).alias("w"))
    return focal.radial_profile(sent).select("ring", r6(F.col("mean_w")).alias("mean_w"), r6(F.col("rel_w")).alias("rel_w"))


@query("A29_mass_by_distance", DIRK + ", " + POP + """, s AS (SELECT kernel, CAST(floor(sqrt(dr * dr + dc * dc)) AS INTEGER) AS ring, sum(juv * w) AS mass FROM pop, ker GROUP BY ALL)
    SELECT kernel, ring, R6(mass) AS mass, R6(sum(mass) OVER (PARTITION BY kernel ORDER BY ring)) AS cum_mass FROM s""")
def _(v):
    return focal.mass_by_distance(population(v), stack()).select("kernel", "ring", r6(F.col("mass")).alias("mass"), r6(F.col("cum_mass")).alias("cum_mass"))


@query("A30_mean_displacement", DIRK + ", " + POP + """, s AS (SELECT kernel, p.juv * w AS m, d FROM pop p, ker
        JOIN off USING (dr, dc) JOIN v_land t ON t.row = p.row + dr AND t.col = p.col + dc)
    SELECT kernel, R6(sum(m * d) / sum(m)) AS mean_all, R6(sum(CASE WHEN d > 0 THEN m * d END) / sum(CASE WHEN d > 0 THEN m END)) AS mean_moved FROM s GROUP BY kernel""")
def _(v):
    out = focal.displacement(population(v), v.land(), stack(), CELL)
    return out.select("kernel", r6(F.col("mean_all")).alias("mean_all"), r6(F.col("mean_moved")).alias("mean_moved"))