"""Correlations, regressions, Gram matrices, loadings, histograms, fit scores."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import equal_bin
from gridloom.functions.ordering import average_ranks, running_totals
from gridloom.operators.clean import one_row

# -- correlation -----------------------------------------------------------------


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of rows where both are present; NULL (no error) for a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def pearson(df: DataFrame, x: str, y: str, min_support: int = 100) -> DataFrame:
    """(n, r) over rows where both are present; no result below ``min_support`` rows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.count("*").alias("n"), correlation(x, y).alias("r")).select("n", F.when(F.col("n") >= min_support, F.col("r")).alias("r"))


def spearman_matrix(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(a, b, rho): rank correlation of every left with every right column, nulls out pairwise."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a in left for b in right
    ]))
    long = df.select(pairs.alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    ranked = average_ranks(average_ranks(long, "x", "rx", group=["a", "b"]), "y", "ry", group=["a", "b"])
    return ranked.groupBy("a", "b").agg(correlation("rx", "ry").alias("rho"))


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def regression_fit(y: Column, pred: Column) -> tuple[Column, Column]:
    """(rmse, r2) aggregates of predictions."""
    r = y - pred
    return F.sqrt(F.avg(r * r)), 1 - F.var_pop(r) / F.var_pop(y)


def mantel(df: DataFrame, vector: str, y: str, key: str) -> DataFrame:
    """Correlation, over all pairs i < j, of x_i . x_j with 1 - |y_i - y_j| / max.

    No pair is formed. Sums over pairs follow from totals (sum x, sum |x|^2, Gram matrix) and,
    for the mixed term, from running sums of x and x*y in the order of y. The distance form
    rescales both sides by negative factors and therefore has the same value.
    """
    base = df.select(key, F.col(y).cast("double").alias("_y"), F.col(vector).alias("_x"))
    dims = base.select(key, "_y", F.posexplode("_x").alias("_d", "_v"))
    run = running_totals(dims, ["_y", key], {"_sx": F.col("_v"), "_sxy": F.col("_v") * F.col("_y")}, group=["_d"])
    before_x, before_xy = F.col("_sx") - F.col("_v"), F.col("_sxy") - F.col("_v") * F.col("_y")
    mixed = run.agg(F.sum(F.col("_v") * (F.col("_y") * before_x - before_xy)).alias("kd"))
    ysort = running_totals(base.select(key, "_y"), ["_y", key], {"_n": F.lit(1.0), "_sy": F.col("_y")})
    dist = ysort.agg(F.sum(F.col("_y") * (F.col("_n") - 1) - (F.col("_sy") - F.col("_y"))).alias("d"))
    sq = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)
    tot = base.agg(
        F.count("*").alias("n"), F.sum("_y").alias("y1"), F.sum(F.col("_y") * F.col("_y")).alias("y2"), F.sum(sq).alias("q1"), F.sum(sq * sq).alias("q2")
    )
    s2 = dims.groupBy("_d").agg(F.sum("_v").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    g2 = gram(base, "_x").agg(F.sum(F.col("g") * F.col("g")).alias("g2"))
    parts = tot.select("*", one_row(mixed)["kd"].alias("kd"), one_row(dist)["d"].alias("d"), one_row(s2)["s2"].alias("s2"), one_row(g2)["g2"].alias("g2"))
    p = F.col("n") * (F.col("n") - 1) / 2
    k1, k2 = (F.col("s2") - F.col("q1")) / 2, (F.col("g2") - F.col("q2")) / 2
    d2 = F.col("n") * F.col("y2") - F.col("y1") * F.col("y1")
    cov = F.col("kd") / p - (k1 / p) * (F.col("d") / p)
    r = cov / F.sqrt((k2 / p - F.pow(k1 / p, 2)) * (d2 / p - F.pow(F.col("d") / p, 2)))
    return parts.select("n", (-r).alias("similarity_r"), (-r).alias("distance_r"))


# -- Gram matrices -----------------------------------------------------------------


def gram(df: DataFrame, vector: str, other: str | None = None) -> DataFrame:
    """(i, j, g) = sum over rows of x_i * y_j (y = x by default).

    Each task adds up its own matrix product; only D x D partial sums are shuffled. Rows with a missing
    element don't count, in any partitioning.
    """
    cols = [vector] if other is None else [vector, other]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[cols[0]].to_numpy()).astype(float)
            y = x if other is None else np.stack(pdf[cols[1]].to_numpy()).astype(float)
            whole = ~(np.isnan(x).any(1) | np.isnan(y).any(1))
            x, y = x[whole], y[whole]
            total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel().astype("int32"), "j": j.ravel().astype("int32"), "g": total.ravel()})

    parts = df.select(*cols).na.drop().mapInPandas(partial, "i INT, j INT, g DOUBLE")
    return parts.groupBy("i", "j").agg(F.sum("g").alias("g"))


def gram_matrix(df: DataFrame, vector: str, dims: int, limit: int = 4096) -> np.ndarray:
    """The D x D Gram on the driver; D is a model dimension, not a data size."""
    if dims > limit:
        raise ValueError(f"{dims} dimensions exceed the driver limit of {limit}")
    out = np.zeros((dims, dims))
    entries = gram(df, vector).toPandas()
    out[entries["i"].to_numpy(), entries["j"].to_numpy()] = entries["g"].to_numpy()
    return out


def effective_rank(df: DataFrame, vector: str) -> DataFrame:
    """(sum s^2)^2 / sum s^4 of the singular values, from traces of the Gram matrix."""
    g = gram(df, vector)
    return g.agg((F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("g"))), 2) / F.sum(F.col("g") * F.col("g"))).alias("effective_rank"))


def participation_rank(df: DataFrame, vector: str, dims: int) -> float:
    """1 / sum((s / sum s)^2) of the singular values."""
    s = np.sqrt(np.clip(np.linalg.eigvalsh(gram_matrix(df, vector, dims)), 0.0, None))
    return float(1.0 / np.sum((s / s.sum()) ** 2))


def orthogonality_error(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """mean((Z'Z/n - I)^2)."""
    n = df.agg(F.count("*").alias("n")).scalar()
    g = gram(df, vector).withColumn("_n", n)
    err = F.col("g") / F.col("_n") - (F.col("i") == F.col("j")).cast("double")
    return g.agg((F.sum(err * err) / (dims * dims)).alias("orthogonality_error"))


def linear_kernel_fidelity(df: DataFrame, z: str, e: str) -> DataFrame:
    """RMSE of z_i.z_j against e_i.e_j over all n^2 pairs, and related diagnostics, pair-free:
    |ZZ' - EE'|^2 = |Z'Z|^2 - 2|Z'E|^2 + |E'E|^2."""

    def square(g: DataFrame) -> Column:
        return g.agg(F.sum(F.col("g") * F.col("g")).alias("s")).scalar()

    def self_dot(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)

    sums = df.select(F.posexplode(z).alias("d", "v")).groupBy("d").agg(F.sum("v").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s"))
    base = df.agg(
        F.count("*").cast("double").alias("n"), F.avg(self_dot(z)).alias("diag_mean"), F.sum(self_dot(z)).alias("_q"),
        F.avg(F.sqrt(self_dot(z))).alias("norm_mean"), F.stddev_pop(F.sqrt(self_dot(z))).alias("norm_sd"),
    ).select("*", square(gram(df, z)).alias("zz"), square(gram(df, z, e)).alias("ze"), square(gram(df, e)).alias("ee"), sums.scalar().alias("_s"))
    n2 = F.col("n") * F.col("n")
    rmse = F.sqrt(F.greatest(F.col("zz") - 2 * F.col("ze") + F.col("ee"), F.lit(0.0)) / n2)
    return base.select(
        rmse.alias("rmse"), (rmse / (F.sqrt(F.col("ee") / n2) + 1e-8)).alias("rmse_norm"),
        (F.col("ze") / F.sqrt(F.col("zz") * F.col("ee"))).alias("alignment"), "norm_mean", "norm_sd", "diag_mean",
        ((F.col("_s") - F.col("_q")) / (n2 - F.col("n"))).alias("offdiag_mean"),
    )


# -- loadings ----------------------------------------------------------------------


def loadings(z: DataFrame, abund: DataFrame, cell: str, dims: int, features: Sequence[str] = ("species", "week"), eps: float = 1e-9) -> DataFrame:
    """(dim, features, loading): correlation of each latent dim with each feature over all cells.

    Absent abundance counts 0, so cross sums need only the stored rows; means and deviations
    come from totals. Each stored row is read once for all dims.
    """
    shared = abund.join(z.select(cell), cell, "left_semi")
    profile = shared.groupBy(cell).agg(F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("x")).alias("_ss")).where("_ss > 0").select(cell)
    zv = z.join(profile, cell, "left_semi")
    zd = [F.get("z", F.lit(d)) for d in range(dims)]
    stats = zv.agg(
        F.count("*").cast("double").alias("n"),
        F.array(*[F.avg(c) for c in zd]).alias("m"),
        F.array(*[F.stddev_pop(c) for c in zd]).alias("s"),
    )
    sums = shared.join(zv, cell).groupBy(*features).agg(
        F.sum("x").alias("_x1"), F.sum(F.col("x") * F.col("x")).alias("_x2"), F.array(*[F.sum(F.col("x") * c) for c in zd]).alias("_zx")
    )
    st = one_row(stats)
    wide = sums.withColumns({"_n": st["n"], "_m": st["m"], "_sd": st["s"]})
    long = wide.select(*features, "_x1", "_x2", "_n", F.posexplode(F.arrays_zip("_zx", "_m", "_sd")).alias("dim", "_e"))
    mean = F.col("_x1") / F.col("_n")
    sd = F.sqrt(F.greatest(F.col("_x2") / F.col("_n") - mean * mean, F.lit(0.0)))
    value = (F.col("_e._zx") / F.col("_n") - F.col("_e._m") * mean) / ((F.col("_e._sd") + eps) * (sd + eps))
    return long.select("dim", *features, F.coalesce(value, F.lit(0.0)).alias("loading"))


def profile_correlation(df: DataFrame, item: str, dim: str, value: str) -> DataFrame:
    """(a, b, r) for items a <= b from their profiles over ``dim``; 0 when undefined.

    Items are a model axis (species, weeks): their profiles are aggregated before the join.
    """
    left = df.select(F.col(item).alias("a"), dim, F.col(value).alias("x"))
    right = df.select(F.col(item).alias("b"), dim, F.col(value).alias("y"))
    return left.join(right, dim).where("a <= b").groupBy("a", "b").agg(F.coalesce(correlation("x", "y"), F.lit(0.0)).alias("r"))


def loading_summaries(load: DataFrame) -> DataFrame:
    """(axis, dim, item, abs_mean, mean) for species and weeks in one pass over the loadings."""
    items = F.explode(F.array(
        F.struct(F.lit("week").alias("axis"), F.col("week").cast("string").alias("item")),
        F.struct(F.lit("species").alias("axis"), F.col("species").alias("item")),
    ))
    long = load.select("dim", "loading", items.alias("i"))
    return long.groupBy("i.axis", "dim", "i.item").agg(F.avg(F.abs("loading")).alias("abs_mean"), F.avg("loading").alias("mean"))


def latent_report(load: DataFrame, k_species: int = 3, k_weeks: int = 5) -> DataFrame:
    """(dim, drivers, avoiders, top_weeks): labels joined in rank order."""

    def first(axis: str, score: Column, k: int) -> Column:
        pairs = F.collect_list(F.when(F.col("axis") == axis, F.struct((-score).alias("o"), F.col("item").alias("i"))))
        return F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"]), ", ")

    return loading_summaries(load).groupBy("dim").agg(
        first("species", F.col("mean"), k_species).alias("drivers"),
        first("species", -F.col("mean"), k_species).alias("avoiders"),
        first("week", F.col("abs_mean"), k_weeks).alias("top_weeks"),
    )


# -- distributions -----------------------------------------------------------------


def histogram(df: DataFrame, value: str, low: Column | float, high: Column | float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    b = equal_bin(F.col(value), low, high, bins)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, xr: tuple[float, float], yr: tuple[float, float], bins: int) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    bx, by = equal_bin(F.col(x), *xr, bins).alias("bx"), equal_bin(F.col(y), *yr, bins).alias("by")
    return both.groupBy(bx, by).agg(F.count("*").alias("n")).where("bx IS NOT NULL AND by IS NOT NULL")


def nodata_profile(df: DataFrame, layer: str, value: str) -> DataFrame:
    """(layer, total, missing, valid, fraction, min, max)."""
    return df.groupBy(layer).agg(
        F.count("*").alias("total"), F.count_if(F.col(value).isNull()).alias("missing"), F.count(value).alias("valid"),
        (F.count_if(F.col(value).isNull()) / F.count("*")).alias("fraction"), F.min(value).alias("min"), F.max(value).alias("max"),
    )


# -- count likelihoods ---------------------------------------------------------------


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling series after shifting the argument by 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def poisson_score(k: Column, mu: Column) -> Column:
    """sum(k log mu - mu); the data-only constant is dropped."""
    return F.sum(k * F.log(mu) - mu)


def negative_binomial_score(k: Column, mu: Column, r: float) -> Column:
    """Log likelihood with concentration r."""
    size = F.lit(float(r))
    return F.sum(
        log_gamma(k + size) - log_gamma(size) - log_gamma(k + 1)
        + size * F.log(size / (size + mu)) + k * F.log(mu / (size + mu))
    )


# -- closed-form regression ------------------------------------------------------------


def bayesian_linear(df: DataFrame, vector: str, y: str, dims: int, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, posterior covariance, noise variance) from one pass of sums; the D x D solve is local."""
    joint = df.select(F.concat(vector, F.array(F.col(y).cast("double"))).alias("v"))
    g = gram_matrix(joint, "v", dims + 1)
    var = df.agg(F.var_pop(y).alias("v")).first()["v"]
    noise = 0.1 * var + 1e-6
    cov = np.linalg.inv(alpha * np.eye(dims) + g[:dims, :dims] / noise)
    return cov @ g[:dims, dims] / noise, cov, noise


def predict_linear(df: DataFrame, vector: str, y: str, weights: np.ndarray, cov: np.ndarray, noise: float) -> DataFrame:
    """Add predictive mean, sd and residual."""

    @F.pandas_udf("mean double, sd double")
    def moments(x: pd.Series) -> pd.DataFrame:
        z = np.stack(x.to_numpy()).astype(float)
        return pd.DataFrame({"mean": z @ weights, "sd": np.sqrt(np.sum(z @ cov * z, axis=1) + noise)})

    m = df.withColumn("_m", moments(F.col(vector)))
    return m.withColumns({"mean": F.col("_m.mean"), "sd": F.col("_m.sd"), "residual": F.col(y) - F.col("_m.mean")}).drop("_m")
