"""Trait, taxonomy and phylogeny tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.ordering import average_ranks
from gridloom.operators.clean import one_row


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key in an explicit order. min_by aggregates before the shuffle, so a
    key that holds a third of the rows costs one row per task, not one sorted group."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_f")).select(key, "_f.*")


def crosswalk(df: DataFrame, key: str, target: str, order: str) -> DataFrame:
    """Drop rows without target, then keep the first per key."""
    return first_per_key(df.where(F.col(target).isNotNull()), key, order)


def require_member(df: DataFrame, focal: str, value) -> DataFrame:
    """Fail when the focal row did not survive earlier filters; else pass all rows."""
    present = df.agg(F.bool_or(F.col(focal) == F.lit(value)).alias("p")).select(
        F.when(F.coalesce("p", F.lit(False)), True).otherwise(F.raise_error(F.lit(f"{focal}={value} is missing")).cast("boolean")).alias("p")
    ).scalar()
    return df.where(present)


def focal_distance(df: DataFrame, focal: str, value, columns: Sequence[str], prefix: str) -> DataFrame:
    """Differences to the focal row and their Euclidean norm; any missing trait -> all missing."""
    ref = one_row(df.where(F.col(focal) == F.lit(value)).select(*columns).limit(1))
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    diffs = {f"{prefix}_diff_{c}": F.when(whole, F.col(c) - ref[c]) for c in columns}
    squares = F.lit(0.0)
    for c in columns:
        squares = squares + F.pow(F.col(c) - ref[c], 2)
    return df.withColumns({**diffs, f"{prefix}_distance": F.when(whole, F.sqrt(squares))})


def mean_rank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average-tie rank per column and the row mean over the available ranks."""
    out = df
    for c in columns:
        out = average_ranks(out, c, f"{c}_rank")
    ranks = F.array_compact(F.array(*[F.col(f"{c}_rank") for c in columns]))
    mean = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(ranks), F.lit(0))
    return out.withColumn("mean_rank", mean)


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, dist) closure of a tree, by repeated equi-joins up to the root.

    The loop ends when no node moves up any more; each round is materialised so that the
    plan stays flat whatever the depth. No tree is deeper than it has nodes: more rounds mean a cycle.
    """
    from gridloom.session import durable

    up = edges.select(F.col("child").alias("_n"), F.col("parent").alias("_p"), F.col("length").alias("_l"))
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    front = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0.0).alias("dist"))
    closure, most = front, nodes.count()
    for _ in range(most):
        front = durable(
            front.join(up, F.col("ancestor") == F.col("_n")).select("node", F.col("_p").alias("ancestor"), (F.col("dist") + F.col("_l")).alias("dist"))
        )
        if front.isEmpty():
            return closure
        closure = closure.unionByName(front)
    raise ValueError("the edges have a cycle")


def patristic_distance(edges: DataFrame, focal: str) -> DataFrame:
    """(node, distance) from ``focal`` to every leaf: the shortest way over a common ancestor."""
    closure = ancestors(edges)
    mine = closure.where(F.col("node") == focal).select("ancestor", F.col("dist").alias("_d"))
    leaves = edges.select(F.col("child").alias("node")).join(edges.select(F.col("parent").alias("node")), "node", "left_anti")
    return (
        closure.join(leaves, "node", "left_semi").join(mine, "ancestor")
        .groupBy("node").agg(F.min(F.col("dist") + F.col("_d")).alias("distance"))
    )


def top_and_bottom(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """k highest and k lowest rows; two bounded top-k heaps, no full sort."""
    top = df.where(F.col(value).isNotNull()).orderBy(F.desc(value), F.asc(tie)).limit(k)
    bottom = df.where(F.col(value).isNotNull()).orderBy(F.asc(value), F.asc(tie)).limit(k)
    high = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), F.asc(tie)))).withColumn("side", F.lit("top"))
    low = bottom.withColumn("rank", F.row_number().over(Window.orderBy(F.asc(value), F.asc(tie)))).withColumn("side", F.lit("bottom"))
    return high.unionByName(low)
