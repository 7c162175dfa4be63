"""Kernels, embeddings, bases, closed-form regression."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import vectors
from gridloom.operators import clean, sampling, similarity, stats, traits, variogram
from gridloom.plans.q_rates import BETA_S, B_SQL
from gridloom.plans.registry import query
from gridloom.plans.views import r6
from gridloom.session import durable


def marks(v, n=16):
    """Landmark cells: a hash sample of the cells."""
    cells = v.abund().select("cell").distinct()
    return sampling.sample_fixed(cells, ["cell"], n, 9)


def sparse(v):
    # a task's vectors, and so the batches Python gets, do not grow with the table
    abund = v.abund()
    vec, width, n = similarity.sparse_vectors(v.deal(abund, "cell"), "cell", species=abund)
    return durable(vec), width, n


def to_sparse_marks(v, kind):
    vec, width, n = sparse(v)
    k = similarity.against_landmarks(vec, vec.join(marks(v), "cell", "left_semi"), "cell", "vec", kind, {"n_species": n}, width)
    return k.select(F.col("cell").alias("i"), F.col("lm").alias("j"), r6(F.col("k")).alias("k"))


def ruzicka_sql(n):
    """Kernel of every cell with n landmark cells, pairs without a shared feature included."""
    return f"""mk AS (SELECT cell FROM (SELECT DISTINCT cell FROM v_abund) ORDER BY md5('9|' || cell), cell LIMIT {n}), lo AS (SELECT a.cell AS i, b.cell AS j, sum(least(a.x, b.x)) AS lo FROM v_abund a JOIN v_abund b USING (species, week) WHERE b.cell IN (SELECT cell FROM mk) GROUP BY ALL), t AS (SELECT cell, sum(x) AS t FROM v_abund GROUP BY cell)
    SELECT a.cell AS i, mk.cell AS j, R6(coalesce(lo / (a.t + b.t - lo), 0)) AS k FROM t a CROSS JOIN mk JOIN t b ON b.cell = mk.cell LEFT JOIN lo ON lo.i = a.cell AND lo.j = mk.cell"""


def additive_sql(n):
    return f"""mk AS (SELECT cell FROM (SELECT DISTINCT cell FROM v_abund) ORDER BY md5('9|' || cell), cell LIMIT {n}), lo AS (SELECT a.cell AS i, b.cell AS j, species, sum(least(a.x, b.x)) AS lo FROM v_abund a JOIN v_abund b USING (species, week) WHERE b.cell IN (SELECT cell FROM mk) GROUP BY ALL), t AS (SELECT cell, species, sum(x) AS t FROM v_abund GROUP BY ALL),
    s AS (SELECT i, j, sum(lo / (a.t + b.t - lo)) / (SELECT count(DISTINCT species) FROM v_abund) AS k FROM lo JOIN t a ON a.cell = i AND a.species = lo.species JOIN t b ON b.cell = j AND b.species = lo.species GROUP BY i, j)
    SELECT c.cell AS i, mk.cell AS j, R6(coalesce(k, 0)) AS k FROM (SELECT DISTINCT cell FROM v_abund) c CROSS JOIN mk LEFT JOIN s ON s.i = c.cell AND s.j = mk.cell"""


@query("K1_global_ruzicka", ruzicka_sql(16))
def _(v):
    return to_sparse_marks(v, "ruzicka")


@query("K2_additive_ruzicka", additive_sql(16))
def _(v):
    return to_sparse_marks(v, "ruzicka_by_species")


@query("K3_ruzicka_pair_loss", """e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS z FROM embeddings), a AS (SELECT z, row_number() OVER (ORDER BY md5('5|' || vec_id), vec_id) AS pair FROM e), b AS (SELECT z, row_number() OVER (ORDER BY md5('6|' || vec_id), vec_id) AS pair FROM e),
    p AS (SELECT pair, unnest(a.z) AS x, unnest(b.z) AS y FROM a JOIN b USING (pair) WHERE pair <= 400), k AS (SELECT pair, sum(least(x, y)) / sum(greatest(x, y)) AS k, sum(x * y) AS d, sum(greatest(x, y)) AS den FROM p GROUP BY pair)
    SELECT count(*) AS n_pairs, R6(avg(pow(k - d, 2))) AS mse FROM k WHERE den > 1e-3""")
def _(v):
    e = v.table("embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x)).alias("z"))
    p = sampling.sample_pairs(e, "vec_id", 400, 5, ["z"])
    high = vectors.total(F.zip_with("z_a", "z_b", lambda x, y: F.greatest(x, y)))
    k = p.where(high > 1e-3).select(vectors.ruzicka(F.col("z_a"), F.col("z_b"), 1e-3).alias("k"), vectors.dot(F.col("z_a"), F.col("z_b")).alias("d"))
    return k.agg(F.count("*").alias("n_pairs"), r6(F.avg(F.pow(F.col("k") - F.col("d"), 2))).alias("mse"))


VEC = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings), m AS (SELECT vec_id AS lm, z AS lz FROM e ORDER BY md5('9|' || vec_id), vec_id LIMIT 16), d AS (SELECT vec_id, lm, pow(list_distance(z, lz), 2) AS d2, list_dot_product(z, lz) AS dp FROM e, m)"


def vecs(v):
    return v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))


def to_marks(v, kind, params=None):
    e = vecs(v)
    return similarity.against_landmarks(e, sampling.sample_fixed(e, ["vec_id"], 16, 9), "vec_id", "z", kind, params)


@query("K4_rbf_kernel", VEC + " SELECT vec_id, lm, R6(exp(-d2 / (2 * 0.8 * 0.8))) AS k, R6(pow(exp(-d2 / (2 * 0.8 * 0.8)), 0.5)) AS k_alpha FROM d")
def _(v):
    return to_marks(v, "rbf", {"lengthscale": 0.8}).select("vec_id", "lm", r6(F.col("k")).alias("k"), r6(F.sqrt("k")).alias("k_alpha"))


@query("K5_rational_quadratic", VEC + " SELECT vec_id, lm, R6(pow(1 + d2 / (2 * 1.5 * 0.8 * 0.8), -1.5)) AS k FROM d")
def _(v):
    return to_marks(v, "rq", {"lengthscale": 0.8, "alpha": 1.5}).select("vec_id", "lm", r6(F.col("k")).alias("k"))


@query("K6_linear_kernel_rows", VEC + " SELECT vec_id, lm, R6(dp) AS k FROM d")
def _(v):
    return to_marks(v, "linear").select("vec_id", "lm", r6(F.col("k")).alias("k"))


def at_full_rank(z, key, n):
    """Products with the landmarks' vectors; with as many dims as landmarks they equal the kernel."""
    z = durable(z)
    out = similarity.with_landmarks(z, sampling.sample_fixed(z, [key], n, 9), key, "z")
    return out.select(F.col(key).alias("i"), F.col("lm").alias("j"), r6(vectors.dot(F.col("z"), F.col("lm_vec"))).alias("k"))


@query("K7_nystrom_ruzicka", ruzicka_sql(64))
def _(v):
    vec, width, _ = sparse(v)
    return at_full_rank(similarity.nystrom(vec, "cell", "vec", 64, 64, "ruzicka", seed=9, width=width), "cell", 64)


@query("K7b_nystrom_additive", additive_sql(64))
def _(v):
    vec, width, n = sparse(v)
    return at_full_rank(similarity.nystrom(vec, "cell", "vec", 64, 64, "ruzicka_by_species", {"n_species": n}, seed=9, width=width), "cell", 64)


@query("K7c_nystrom_linear_exact", """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings) SELECT vec_id, round(list_dot_product(z, z), 5) + 0.0 AS norm2 FROM e""")
def _(v):
    # at full rank the embedding reproduces the kernel, so squared norms must agree
    z = similarity.nystrom(vecs(v), "vec_id", "z", 64, 200, "linear", seed=9)
    return z.select("vec_id", (F.round(vectors.dot(F.col("z"), F.col("z")), 5) + 0.0).alias("norm2"))


@query("K7d_nystrom_rational_quadratic", VEC.replace("LIMIT 16", "LIMIT 100") + " SELECT vec_id AS i, lm AS j, R6(pow(1 + d2 / (2 * 1.5 * 0.8 * 0.8), -1.5)) AS k FROM d")
def _(v):
    z = similarity.nystrom(vecs(v), "vec_id", "z", 100, 100, "rq", {"lengthscale": 0.8, "alpha": 1.5}, seed=9)
    return at_full_rank(z, "vec_id", 100)


RNG = np.random.default_rng(11)
RFF_W = [[round(float(x), 6) for x in row] for row in RNG.normal(size=(8, 64))]
RFF_B = [round(float(x), 6) for x in RNG.uniform(0, 2 * np.pi, size=8)]


@query("K8_random_fourier", f"""w AS (SELECT unnest(range(8))::INTEGER AS f, unnest({RFF_W}::DOUBLE[][]) AS w, unnest({RFF_B}::DOUBLE[]) AS b)
    SELECT vec_id, f, R6(cos(list_dot_product(CAST(embedding AS DOUBLE[]), w) + b) * sqrt(2.0::DOUBLE / 8)) AS phi FROM embeddings, w""")
def _(v):
    phi = similarity.random_fourier(F.col("z"), np.array(RFF_W), np.array(RFF_B))
    return vecs(v).select("vec_id", F.posexplode(phi).alias("f", "phi")).select("vec_id", "f", r6(F.col("phi")).alias("phi"))


@query("K9_iso_similarity", "f AS (SELECT row AS fr, col AS fc, z AS fz FROM v_z WHERE (row, col) IN ((0, 3), (2, 11), (4, 20))) SELECT row, col, CAST(fr * 25 + fc AS INTEGER) AS focal, R6(list_dot_product(z, fz)) AS sim FROM v_z, f")
def _(v):
    z = v.z().withColumn("id", F.col("row") * 25 + F.col("col"))
    focal = z.where(F.col("id").isin(3, 61, 120))
    out = similarity.with_landmarks(z, focal, "id", "z")
    return out.select("row", "col", F.col("lm").alias("focal"), r6(vectors.dot(F.col("z"), F.col("lm_vec"))).alias("sim"))


VARIO = """zi AS (SELECT row * 25 + col AS id, row, col, z FROM v_z), a AS (SELECT *, row_number() OVER (ORDER BY md5('5|' || id), id) AS pair FROM zi), b AS (SELECT *, row_number() OVER (ORDER BY md5('6|' || id), id) AS pair FROM zi),
    p AS (SELECT sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) AS d, 1 - list_dot_product(a.z, b.z) AS e FROM a JOIN b USING (pair) WHERE pair <= 400), c AS (SELECT * FROM p WHERE d <= 18)"""


@query("K10_variogram", VARIO + " SELECT CAST(floor(d / 2) AS INTEGER) AS bin, count(*) AS n, R6(avg(e)) AS turnover, (SELECT R6(regr_slope(e, d)) FROM c) AS slope FROM c GROUP BY 1")
def _(v):
    z = v.z().withColumn("id", F.col("row") * 25 + F.col("col"))
    p = sampling.sample_pairs(z, "id", 400, 5, ["row", "col", "z"])
    d = F.sqrt(F.pow(F.col("row_a") - F.col("row_b"), 2) + F.pow(F.col("col_a") - F.col("col_b"), 2))
    c = p.select(d.alias("d"), (1 - vectors.dot(F.col("z_a"), F.col("z_b"))).alias("e")).where("d <= 18")
    slope = c.agg(r6(F.regr_slope("e", "d")).alias("s")).scalar()
    return c.groupBy(F.floor(F.col("d") / 2).cast("int").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("e")).alias("turnover")).withColumn("slope", slope)


@query("K10_variogram_all_pairs", """p AS (SELECT sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) AS d, 1 - list_dot_product(a.z, b.z) AS e, list_dot_product(a.z, a.z) + list_dot_product(b.z, b.z) - 2 * list_dot_product(a.z, b.z) AS s
        FROM v_z a JOIN v_z b ON b.row BETWEEN a.row AND a.row + 18 AND (b.row > a.row OR b.col > a.col)), c AS MATERIALIZED (SELECT * FROM p WHERE d <= 18)
    SELECT CAST(floor(d / 2) AS INTEGER) AS bin, count(*) AS n, R6(avg(e)) AS turnover, R6(avg(s) / 2) AS semivariance, (SELECT R6(regr_slope(e, d)) FROM c) AS slope FROM c GROUP BY 1""")
def _(v):
    t = variogram.turnover(v.z(), "z", 64, 18, 2.0)
    return t.select("bin", "n", *[r6(F.col(c)).alias(c) for c in ("turnover", "semivariance", "slope")])


@query("K11_focal_distance", """f AS (SELECT size AS fs, qty AS fq, disc AS fd FROM v_traits WHERE part = 7) SELECT part, CASE WHEN disc IS NOT NULL THEN size - fs END AS trait_diff_size, CASE WHEN disc IS NOT NULL THEN qty - fq END AS trait_diff_qty,
    R6(sqrt(pow(size - fs, 2) + pow(qty - fq, 2) + pow(disc - fd, 2))) AS trait_distance FROM v_traits, f""")
def _(v):
    d = traits.focal_distance(v.traits(), "part", 7, ["size", "qty", "disc"], "trait")
    return d.select("part", "trait_diff_size", "trait_diff_qty", r6(F.col("trait_distance")).alias("trait_distance"))


def squares(n, source):
    """Thirty squarings of the matrix of ``source``: the columns turn to its leading eigenvector."""
    return f"""p{n} AS (SELECT 0 AS it, c AS m FROM {source} UNION ALL SELECT it + 1, list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s) / f))
        FROM (SELECT it, m, list_sum(list_transform(m, lambda r: list_dot_product(r, r))) AS f FROM p{n} WHERE it < 30)),
    w{n} AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS w FROM (SELECT unnest(m) AS r FROM p{n} WHERE it = 30) ORDER BY list_dot_product(r, r) DESC LIMIT 1),
    v{n} AS MATERIALIZED (SELECT list_transform(w, lambda x: x * s) AS v FROM (SELECT w, CASE WHEN list_max(w) >= -list_min(w) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM w{n})),
    l{n} AS MATERIALIZED (SELECT list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS l FROM {source}, v{n}),
    c{n + 1} AS MATERIALIZED (SELECT list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS c FROM {source}, v{n}, l{n})"""


PCA = """st AS (SELECT i, avg(z[i]) AS m, stddev_pop(z[i]) AS s FROM (SELECT CAST(embedding AS DOUBLE[]) AS z FROM embeddings), range(1, 65) t(i) GROUP BY i), ms AS MATERIALIZED (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM st),
    sv AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: (x - m[i]) / s[i]) AS v FROM embeddings, ms), g AS (SELECT i, j, avg(v[i] * v[j]) AS g FROM sv, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL),
    c1 AS MATERIALIZED (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(g ORDER BY j) AS r FROM g GROUP BY i)), """ + ", ".join(squares(n, f"c{n}") for n in (1, 2, 3))


@query("K13_principal_components", PCA + """ SELECT vec_id, [R6(list_dot_product(sv.v, v1.v) / sqrt(l1.l)), R6(list_dot_product(sv.v, v2.v) / sqrt(l2.l)), R6(list_dot_product(sv.v, v3.v) / sqrt(l3.l))] AS pc,
    R6((l1.l + l2.l + l3.l) / 64) AS explained FROM sv, v1, v2, v3, l1, l2, l3""")
def _(v):
    scores, ratios = similarity.principal_components(vecs(v), "vec_id", "z", 64, 3)
    return scores.select("vec_id", F.transform("pc", lambda x: r6(x)).alias("pc")).withColumn("explained", r6(F.lit(float(ratios.sum()))))


SINE = "j AS (SELECT j1, j2, CAST((j1 - 1) * 3 + j2 - 1 AS INTEGER) AS b FROM range(1, 4) AS a(j1), range(1, 4) AS c(j2)), ph AS (SELECT vec_id, b, j1, j2, (sqrt(1 / 5.0::DOUBLE) * sin(pi() * j1 * (z1 + 5) / 10)) * (sqrt(1 / 5.0::DOUBLE) * sin(pi() * j2 * (z2 + 5) / 10)) AS phi FROM (SELECT vec_id, embedding[1]::DOUBLE AS z1, embedding[2]::DOUBLE AS z2 FROM embeddings), j)"


def axes(v):
    return vecs(v), [F.get("z", F.lit(0)), F.get("z", F.lit(1))]


@query("K14_sine_basis", SINE + " SELECT vec_id, b, R6(phi) AS phi FROM ph")
def _(v):
    e, xs = axes(v)
    return e.select("vec_id", F.posexplode(F.array(*similarity.sine_basis(xs, 3, 5.0))).alias("b", "phi")).select("vec_id", "b", r6(F.col("phi")).alias("phi"))


BASIS_W = [((i * 5) % 9 - 4) / 4 for i in range(9)]


@query("K15_basis_field", SINE + """, w AS (SELECT *, phi * ((b * 5) % 9 - 4) / 4.0::DOUBLE * 1.5 * sqrt(2 * pi()) * 0.7 * exp(-0.25 * 0.7 * 0.7 * (pow(pi() * j1 / 10, 2) + pow(pi() * j2 / 10, 2))) AS t FROM ph), f AS (SELECT vec_id, sum(t) AS f FROM w GROUP BY vec_id)
    SELECT vec_id, R6(0.8 * f + 0.2 * f * f) AS r, R6(0.3 * f - 0.6 * f * f) AS k FROM f""")
def _(v):
    e, xs = axes(v)
    f = e.select("vec_id", similarity.basis_field(xs, 3, 5.0, similarity.sine_spectrum(3, 2, 5.0, 1.5, 0.7), BASIS_W).alias("f"))
    g = F.col("f") * F.col("f")
    return f.select("vec_id", r6(0.8 * F.col("f") + 0.2 * g).alias("r"), r6(0.3 * F.col("f") - 0.6 * g).alias("k"))


@query("K15_basis_field_all_dims", """x AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: pi() * (e + 5) / 10) AS t FROM embeddings),
    fn AS (SELECT 0 AS b, 0 AS d, 0 AS e, 64 AS sq UNION ALL SELECT d, d, 0, 67 FROM range(1, 65) a(d)
        UNION ALL SELECT 65 + (d - 1) * 64 - (d - 1) * (d - 2) // 2 + e - d, d, e, CASE WHEN d = e THEN 72 ELSE 70 END FROM range(1, 65) a(d), range(1, 65) c(e) WHERE d <= e),
    w AS MATERIALIZED (SELECT d, e, ((b * 5) % 9 - 4) / 4.0::DOUBLE * 1.5 * exp(-0.25 * 0.7 * 0.7 * sq * pow(pi() / 10, 2)) AS w FROM fn),
    f AS (SELECT vec_id, list_product(any_value(list_transform(t, lambda a: sin(a)))) * sum(w * CASE WHEN d = 0 THEN 1 WHEN e = 0 THEN 2 * cos(t[d]) WHEN d = e THEN 4 * cos(t[d]) * cos(t[d]) - 1 ELSE 4 * cos(t[d]) * cos(t[e]) END) AS f FROM x, w GROUP BY vec_id)
    SELECT vec_id, R6(0.8 * f + 0.2 * f * f) AS r, R6(0.3 * f - 0.6 * f * f) AS k FROM f""")
def _(v):
    weights = [((b * 5) % 9 - 4) / 4 for b in range(len(similarity.sine_index(64, 2)))]
    f = similarity.sine_field(vecs(v), "z", 64, 2, 5.0, lambda w2: 1.5 * np.exp(-0.25 * 0.7 * 0.7 * w2), weights, unit=True)
    g = F.col("f") * F.col("f")
    return f.select("vec_id", r6(0.8 * F.col("f") + 0.2 * g).alias("r"), r6(0.3 * F.col("f") - 0.6 * g).alias("k"))


# the inverse of the posterior precision by Newton steps X (2 I - A X)
BLR = """d AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z, label::DOUBLE AS y FROM embeddings), s AS MATERIALIZED (SELECT 0.1 * var_pop(y) + 1e-6 AS s2 FROM d),
    g AS (SELECT i, j, g / s2 + CASE WHEN i = j THEN 1 ELSE 0 END AS g FROM s, (SELECT i, j, sum(z[i] * z[j]) AS g FROM d, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j)), a AS MATERIALIZED (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(g ORDER BY j) AS r FROM g GROUP BY i)),
    x AS (SELECT 0 AS it, list_transform(a, lambda r, i: list_transform(r, lambda e, j: CASE WHEN i = j THEN 1 / f ELSE 0.0::DOUBLE END)) AS x FROM (SELECT a, sqrt(list_sum(list_transform(a, lambda r: list_dot_product(r, r)))) AS f FROM a)
        UNION ALL SELECT it + 1, list_transform(x, lambda r: list_transform(t, lambda c: list_dot_product(r, c))) FROM (SELECT it, x, list_transform(x, lambda c, j: list_transform(a, lambda r, i: CASE WHEN i = j THEN 2 ELSE 0 END - list_dot_product(r, c))) AS t FROM x, a WHERE it < 18)),
    c AS MATERIALIZED (SELECT x AS c FROM x WHERE it = 18), u AS (SELECT list(u ORDER BY i) AS u FROM (SELECT i, sum(z[i] * y) / any_value(s2) AS u FROM d, s, range(1, 65) b(i) GROUP BY i)), w AS MATERIALIZED (SELECT list_transform(c, lambda r: list_dot_product(r, u)) AS w FROM c, u)"""


@query("K16_bayesian_regression", BLR + " SELECT vec_id, R6(list_dot_product(z, w)) AS mean, R6(sqrt(list_dot_product(z, list_transform(c, lambda r: list_dot_product(r, z))) + s2)) AS sd, R6(y - list_dot_product(z, w)) AS residual FROM d, s, c, w")
def _(v):
    d = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"), F.col("label").cast("double").alias("y"))
    out = stats.predict_linear(d, "z", "y", *stats.bayesian_linear(d, "z", "y", 64))
    return out.select("vec_id", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "residual")])


@query("K17_parameter_sweep")
def _(v):
    kernels = [("ruzicka", None, None), ("ruzicka_by_species", None, None), ("rbf", 0.5, 1.0), ("rq", 0.5, 1.5), ("rq", 1.0, 1.5), ("rq", 0.5, 3.0)]
    s = similarity.sweep(v.abund(), "cell", [0.5, 1.5], [4, 8], 48, 300, kernels, seed=9)
    return s.select("sigma", "kind", "lengthscale", "alpha", "dim", *[F.round(c, 5).alias(c) for c in ("rank", "rmse", "utility")])


@query("K18_map_scoring", B_SQL + """, st AS (SELECT dim, avg(zv) AS mu, stddev_samp(zv) AS sd FROM v_zlong WHERE row < 10 GROUP BY dim)
    SELECT row, col, R6(sum((zv - mu) / (sd + 1e-6) * bs[dim + 1])) AS score FROM v_zlong JOIN st USING (dim), b GROUP BY row, col""")
def _(v):
    z = v.zlong()
    scored = clean.normalize_by(z, z.where("row < 10"), "dim", "zv")
    beta = F.get(vectors.lit_array(BETA_S), F.col("dim"))
    return scored.groupBy("row", "col").agg(r6(F.sum(F.col("zv") * beta)).alias("score"))


@query("P49_distance_similarity", """a AS (SELECT part AS lm, qty AS q FROM v_traits ORDER BY md5('4|' || part), part LIMIT 10), r AS (SELECT max(qty) - min(qty) AS r FROM v_traits)
    SELECT part, lm, 1 - abs(qty - q) / r AS similarity FROM v_traits, a, r""")
def _(v):
    t = v.traits().select("part", "qty")
    return similarity.distance_similarity(t, sampling.sample_fixed(t, ["part"], 10, 4), "part", "qty")
