"""Demographic rates and source-sink diagnostics over cell-year tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.links import clip, positive_link, sigmoid
from gridloom.functions.text import parse_kernel_label
from gridloom.functions.vectors import dot, lit_array


def demographic_rates(habitat_s: Column, habitat_r: Column, p: dict[str, float], link: str = "softplus") -> dict[str, Column]:
    """Survival listens to ``habitat_s``, reproduction to ``habitat_r``."""

    def linear(name: str, h: Column) -> Column:
        return F.lit(p[f"alpha_{name}"]) + F.lit(p[f"gamma_{name}"]) * h

    return {
        "Sa": sigmoid(linear("a", habitat_s)),
        "Sj": sigmoid(linear("j", habitat_s)),
        "Fmax": positive_link(linear("f", habitat_r), link),
        "K": positive_link(linear("k", habitat_r), link),
    }


def journey_survival(habitat_disp: Column, p: dict[str, float]) -> Column:
    return sigmoid(F.lit(p["alpha_j"]) + F.lit(p["gamma_j"]) * habitat_disp)


def growth_rates(latents: Column, p: dict[str, Sequence[float] | float]) -> dict[str, Column]:
    """Earlier parametrisation: growth, capacity and survival from latent factors."""
    return {
        "r": F.lit(p["r_mean"]) + dot(latents, lit_array(p["L_r"])),
        "K": F.exp(F.lit(p["K_mean"]) + dot(latents, lit_array(p["L_K"]))),
        "s": sigmoid(dot(latents, lit_array(p["l_surv"])) + F.lit(p["threshold"])),
    }


def replacement_rate(sa: Column, sj: Column, fmax: Column) -> Column:
    """R0 = F * Sj / (1 - Sa + 1e-6)."""
    return fmax * sj / (F.lit(1.0) - sa + 1e-6)


def effective_growth(r: Column, f: Column, q: Column) -> Column:
    """r + log(1 - f + f*Q)."""
    return r + F.log(F.lit(1.0) - f + f * q + 1e-12)


def migrant_growth(r: Column, phi: Column) -> Column:
    return r + F.log(F.greatest(phi, F.lit(1e-6)))


def source_sink(r0: Column, low: float = 0.9, high: float = 1.1) -> Column:
    """source / marginal / sink; missing stays missing."""
    return F.when(r0 > high, "source").when(r0 < low, "sink").when(r0.isNotNull(), "marginal")


def four_way(a: Column, b: Column, threshold: float) -> Column:
    code = 2 * (a > threshold).cast("int") + (b > threshold).cast("int")
    return F.when(code == 3, "both").when(code == 2, "only_a").when(code == 1, "only_b").when(code == 0, "neither")


def directional_delta(df: DataFrame, keys: Sequence[str], fitness: str = "fitness") -> DataFrame:
    """Opposite-direction fitness per distance bin, from ``kernel`` labels ``to_DIR_lo-hi``."""
    parsed = df.withColumns(parse_kernel_label(F.col("kernel")))

    def side(d: str) -> Column:
        return F.max(F.when(F.col("direction") == d, F.col(fitness)))

    return parsed.groupBy(*keys, "dist_bin").agg(
        side("EAST").alias("from_west"), side("WEST").alias("from_east"),
        side("NORTH").alias("from_south"), side("SOUTH").alias("from_north"),
    ).withColumns({
        "delta_we": F.col("from_west") - F.col("from_east"),
        "delta_sn": F.col("from_south") - F.col("from_north"),
    })


def ablation(df: DataFrame, keys: Sequence[str], z: str, beta_s: Sequence[float], beta_r: Sequence[float], p: dict[str, float]) -> DataFrame:
    """R0 change when feature i is set to 0, one row per feature."""
    hs, hr = dot(F.col(z), lit_array(beta_s)), dot(F.col(z), lit_array(beta_r))
    base = df.select(*keys, hs.alias("_hs"), hr.alias("_hr"), F.posexplode(
        F.zip_with(F.col(z), F.zip_with(lit_array(beta_s), lit_array(beta_r), lambda a, b: F.struct(a.alias("s"), b.alias("r"))),
                   lambda v, b: F.struct((v * b["s"]).alias("s"), (v * b["r"]).alias("r")))
    ).alias("feature", "_c"))

    def r0(h_s: Column, h_r: Column) -> Column:
        rates = demographic_rates(h_s, h_r, p)
        return replacement_rate(rates["Sa"], rates["Sj"], rates["Fmax"])

    return base.select(
        *keys, "feature",
        (r0(F.col("_hs") - F.col("_c.s"), F.col("_hr") - F.col("_c.r")) - r0(F.col("_hs"), F.col("_hr"))).alias("delta"),
    )


def keystone(ablated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Feature with the largest absolute change; the lower index wins a tie."""
    return ablated.groupBy(*keys).agg(F.max_by("feature", F.struct(F.abs("delta"), -F.col("feature"))).alias("keystone"))


def contributions(z: Column, beta: Sequence[float]) -> Column:
    return F.zip_with(z, lit_array(beta), lambda a, b: a * b)


def limiting_feature(c: Column) -> Column:
    """0-based position of the smallest contribution."""
    return (F.array_position(c, F.array_min(c)) - 1).cast("int")


def driving_feature(c: Column) -> Column:
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def predicted_counts(obs: DataFrame, pred: DataFrame, scalar: float, keys: Sequence[str]) -> DataFrame:
    """Expected count of each observation: density x scalar, floored at 1e-6."""
    return obs.join(pred, list(keys), "left").withColumn("mu", F.greatest(F.col("density") * scalar, F.lit(1e-6)))


def log_residuals(df: DataFrame) -> DataFrame:
    """Time mean of log1p(obs) - log1p(pred) per cell; missing observations are skipped."""
    return df.groupBy("row", "col").agg(F.avg(F.log1p("obs") - F.log1p("pred")).alias("residual"))


def utility(rank: Column, rmse: Column) -> Column:
    """rank * (1 - rmse), 0 for near-noise (rmse > 0.95) and near-constant (rank < 2) embeddings."""
    return F.when((rmse > 0.95) | (rank < 2.0), 0.0).otherwise(rank * (1.0 - rmse))


def capped_density(count: Column, visits: Column, cap: float = 50.0, min_effort: float = 0.0) -> Column:
    """count per visit over ``cap`` clipped to [0, 1]; missing below ``min_effort`` visits."""
    return F.when(visits >= min_effort, clip(F.try_divide(count, visits) / cap, 0, 1))
