"""Deterministic sampling, splitting and fronts.

Random choices are hashes of the keys and a seed, so they do not depend on partitioning,
on retries or on lost executors.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.ordering import row_numbers, running_min_before


def hash_key(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_fixed(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows without replacement; n is a small parameter (landmarks, pairs), kept by a bounded heap."""
    return df.orderBy(hash_key(keys, seed), *keys).limit(n)


def sample_share(df: DataFrame, keys: Sequence[str], n: Column, seed: int) -> DataFrame:
    """n rows without replacement where n may grow with the data."""
    hashed = df.withColumn("_h", hash_key(keys, seed)).withColumn("_n", n)
    return row_numbers(hashed, ["_h", *keys], "_rn").where(F.col("_rn") <= F.col("_n")).drop("_h", "_n", "_rn")


def sample_per_group(df: DataFrame, group: str, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows per group; every task passes on at most n of a group, so a hot group is never gathered."""
    hashed = df.withColumn("_h", hash_key([group, *keys], seed))
    order = Window.partitionBy(group).orderBy("_h", *keys)
    return hashed.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_h", "_rn")


def sample_pairs(df: DataFrame, key: str, n: int, seed: int, payload: Sequence[str] = ()) -> DataFrame:
    """n random pairs (pair, a, b): two hash orders matched by position; an empty table gives none.

    Rows are used again once all were drawn, in fresh orders each round, so n may exceed the table.
    """
    rows = df.select(key).limit(n).count()
    rounds = -(-n // max(rows, 1))

    def side(tag: str, s: int) -> DataFrame:
        # n rows at most are kept and drawn about n times in all: every step is bounded by the parameter
        drawn = sample_fixed(df.select(key, *payload), [key], n, s).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        order = Window.partitionBy("_c").orderBy(F.md5(F.concat_ws("|", (F.lit(s) + 2 * F.col("_c")).cast("string"), F.col(key).cast("string"))), key)
        return drawn.select(
            (F.col("_c") * rows + F.row_number().over(order)).alias("pair"), F.col(key).alias(f"{key}_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in payload]
        ).where(F.col("pair") <= n)

    return side("a", seed).join(side("b", seed + 1), "pair")


def block_of(index: Column, size: Column, blocks: int) -> Column:
    """Block number when ``size`` positions are cut in ``blocks`` parts, longer parts first."""
    short = F.floor(size / blocks)
    longer = size % blocks
    edge = longer * (short + 1)
    return F.when(index < edge, F.floor(index / (short + 1))).otherwise(longer + F.floor((index - edge) / F.greatest(short, F.lit(1)))).cast("int")


def block_split(df: DataFrame, nrows: Column, ncols: Column, blocks: int = 8, train: float = 0.8) -> DataFrame:
    """Add ``is_train``: the first share of the non-empty blocks in row-major order."""
    tagged = df.withColumn("_b", block_of(F.col("row"), nrows, blocks) * blocks + block_of(F.col("col"), ncols, blocks))
    present = tagged.select("_b").distinct()
    n_train = F.floor(F.count("*").over(Window.partitionBy(F.lit(1))) * train)
    # at most blocks^2 rows
    ranked = present.select("_b", (F.row_number().over(Window.orderBy("_b")) <= n_train).alias("is_train"))
    return tagged.join(ranked, "_b").drop("_b")


def row_split(df: DataFrame, keys: Sequence[str], seed: int, percent: int = 80) -> DataFrame:
    """Add ``is_train`` by hash; both sides are disjoint."""
    bucket = F.conv(F.substring(hash_key(keys, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("is_train", F.pmod(bucket, F.lit(100)) < percent)


def pareto_front(df: DataFrame, high: str, low: str) -> DataFrame:
    """Rows no other row beats on ``high`` (more is better) and ``low`` (less is better).

    Each value of ``high`` keeps its best ``low``; a running minimum over better values of
    ``high`` then tells dominated rows apart without comparing pairs.
    """
    best = df.groupBy(high).agg(F.min(low).alias("_best")).withColumn("_neg", -F.col(high))
    front = running_min_before(best, ["_neg"], "_best", "_before").where(F.col("_before").isNull() | (F.col("_best") < F.col("_before")))
    return df.join(front.select(high, F.col("_best").alias(low)), [high, low], "left_semi")


def grid_window(df: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    return df.where(F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1))
