"""Exact nearest neighbours among binary codes by incremental multi-index hashing.

A vector's code has a bit per dimension (1: above zero). Codes are cut into segments of 16 bits. If two codes
differ in fewer than m(r + 1) bits, at least one of their m segments differs in at most r: the search looks up, for radius
0, 1, ..., all segment values that differ in that many bits, verifies the full distance of what it finds, and
leaves a query when as many codes as asked for lie within m(r + 1) - 1 bits, since nothing nearer can be missing.

Equal codes are one entry that carries its smallest ids, so a vector that a third of all rows share is one row of the
index; queries with equal codes are searched once. Neighbours are ranked by distance, then id, and a query is
not its own neighbour. Null ids and null vectors take no part; null components are 0 bits. Rows of the same id and
code count once. Vectors may be longer or shorter than others: missing components are 0 bits. Fewer neighbours
than asked for come back only if there are no more.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.links import Kept

BITS = 16


def codes(vectors: DataFrame, ident: str, vector: str, dims: int) -> DataFrame:
    """id and code (an array of 64-bit words)."""

    def word(w: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(w * 64, min(dims, w * 64 + 64)):
            bit = F.when(F.coalesce(F.get(F.col(vector), F.lit(i)) > 0, F.lit(False)), F.shiftleft(F.lit(1).cast("long"), i % 64)).otherwise(F.lit(0).cast("long"))
            out = out.bitwiseOR(bit)
        return out

    words = F.array(*[word(w) for w in range((dims + 63) // 64)])
    return vectors.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), words.alias("code")).distinct()


def _segments(code: str, m: int) -> list[Column]:
    return [F.shiftrightunsigned(F.get(F.col(code), F.lit(s // 4)), BITS * (s % 4)).bitwiseAND(F.lit((1 << BITS) - 1)) for s in range(m)]


def _distance(a: str, b: str, words: int) -> Column:
    total = F.lit(0)
    for w in range(words):
        total = total + _bits(F.get(F.col(a), F.lit(w)), F.get(F.col(b), F.lit(w)))
    return total


def _bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, neighbour_id, distance: the ``k`` nearest rows of ``vectors`` of every row of ``queries``."""
    spark, kept = vectors.sparkSession, Kept(vectors.sparkSession)
    dims = max(vectors.agg(F.max(F.size(vector))).first()[0] or 0, queries.agg(F.max(F.size(vector))).first()[0] or 0, 1)
    m = (dims + BITS - 1) // BITS
    want = k + 1  # the query itself may be among them
    rows = codes(vectors, ident, vector, dims)
    few = Window.partitionBy("code").orderBy("id")
    smallest = rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= want)
    index = kept.keep(smallest.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    probes = index.select("code", F.col("ids")[0].alias("first"), F.size("ids").alias("n"), F.posexplode(F.array(*_segments("code", m))).alias("s", "v"))
    asked = kept.keep(codes(queries, ident, vector, dims).withColumnRenamed("id", "query_id").withColumnRenamed("code", "q"))
    active, best = kept.keep(asked.select("q", F.lit(dims + 64).alias("cutoff")).distinct()), None
    nearest = Window.partitionBy("q").orderBy("distance", "first")
    done = []
    for radius in range(BITS + 1):
        masks = F.split(F.lit(",".join(str(x) for x in range(1 << BITS) if x.bit_count() == radius)), ",").cast("array<bigint>")
        looked = active.select("q", "cutoff", F.posexplode(F.array(*_segments("q", m))).alias("s", "v0")).select("q", "cutoff", "s", F.explode(masks).alias("mask"), "v0").select("q", "cutoff", "s", F.col("v0").bitwiseXOR(F.col("mask")).alias("v"))
        # the looked-up values are many more than Spark expects: never broadcast
        found = looked.join(probes.hint("shuffle_hash"), ["s", "v"])
        # taken where the first segment at the smallest segment distance finds it: never twice
        apart = F.array(*[_bits(a, b) for a, b in zip(_segments("q", m), _segments("code", m))])
        found = found.withColumn("apart", apart).where((F.array_min("apart") == radius) & (F.array_position("apart", radius) == F.col("s") + 1))
        distance = _distance("q", "code", (dims + 63) // 64)
        # nothing beyond the last place that is already taken
        found = found.where(distance <= F.col("cutoff")).select("q", "code", "first", "n", distance.alias("distance"))
        pool = found if best is None else best.join(active, "q", "left_semi").union(found)
        best = kept.keep(pool.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= want).drop("place"))
        covered = best.where(F.col("distance") <= m * (radius + 1) - 1).groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") >= want).select("q")
        if radius == BITS:
            done.append(best)
            break
        done.append(best.join(covered, "q", "left_semi"))
        last = best.groupBy("q").agg(F.when(F.count("*") >= want, F.max("distance")).alias("last"))
        active = kept.keep(active.join(covered, "q", "left_anti").join(last, "q", "left").select("q", F.coalesce("last", "cutoff").alias("cutoff")))
        if active.isEmpty():
            break
    settled = done[0]
    for part in done[1:]:
        settled = settled.union(part)
    flat = settled.join(index, "code").select("q", "distance", F.explode("ids").alias("neighbour_id"))
    order = Window.partitionBy("q").orderBy("distance", "neighbour_id")
    flat = flat.withColumn("place", F.row_number().over(order)).where(F.col("place") <= want)
    mine = Window.partitionBy("query_id", "q").orderBy("distance", "neighbour_id")
    ranked = asked.join(flat, "q").where("query_id <> neighbour_id").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbour_id", "distance")
