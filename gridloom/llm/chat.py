"""Dialogues seen by each of their participants: that one speaks as the assistant, the others as named users.

A participant is a speaker other than ``system``; system turns stay system turns in every perspective. The
result has one row per (dialogue, perspective, turn): the rendered segment, where it and its content lie in
the rendered dialogue (code points), and whether the content is trained on (the assistant's is). Segments in
order, joined by nothing, are the rendered dialogue; ``Column`` functions only, and a dialogue of any length
is never gathered: places come from running sums over ranges of turns.

Turns with the same number follow by role, then text; repeated turns are kept, each as a turn of its own. Null
texts are empty, null or empty speakers are ``unknown``, null turn numbers come first, and a null
conv_id is a dialogue like any other. A dialogue of system turns only has no participant and no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turns (by hash-free range of their order) of one block; a block's running sums are one small window.
BLOCK = 4096
OPEN, CLOSE = "<|start|>", "<|end|>\n"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    who = F.when(F.coalesce(F.col(speaker), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(speaker))
    plain = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), who.alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # repeated turns are counted, not ordered among themselves
    plain = plain.groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("times"))
    people = plain.where("speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seen = plain.join(people, plain["conv_id"].eqNullSafe(people["conv_id"])).drop(people["conv_id"])
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("assistant")).when(F.col("speaker") == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    opening = F.concat(F.lit(OPEN), head, F.lit("\n"))
    seen = seen.withColumns({"segment": F.concat(opening, F.col("text"), F.lit(CLOSE)), "lead": F.length(opening).cast("long"), "trained": own})
    seen = seen.withColumns({"size": F.length("segment").cast("long"), "block": F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK)})
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = seen.groupBy("conv_id", "perspective", "block").agg(F.sum(F.col("size") * F.col("times")).alias("s"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    placed = seen.withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("times")).over(inside), F.lit(0)))
    placed = placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    each = placed.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    start = F.col("base") + F.col("at") + F.col("repeat") * F.col("size")
    return each.select("conv_id", "perspective", "turn", "speaker", "segment", start.alias("segment_start"), (start + F.col("lead")).alias("content_start"),
                       (start + F.col("size") - len(CLOSE)).alias("content_end"), "trained")
