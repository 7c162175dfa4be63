"""Exact token counts of a corpus from the histogram of encoded lengths.

One pass encodes every whole text and counts texts by length. Suffix sums over the histogram then answer, for
any context limit, how many texts reach it, how many tokens all texts have when cut there, and quantiles.
Sums run inside blocks of lengths and over block totals, so no window holds the whole histogram.

Null and empty texts have length 0 and count. An empty table has no rows.
"""
from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm import flat
from gridloom.llm.links import Kept

BLOCK = 1024


def encoder(path: str, pattern: str):
    """A byte-level BPE encoding from a rank file."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` and the encoded length of each text."""

    def make():
        encode = encoder(path, pattern).encode_ordinary
        return lambda texts: [[len(encode(t)) if t else 0 for t in texts.to_pylist()]]

    return flat.with_columns(docs, text, {name: (T.LongType(), pa.int64())}, make)


def histogram(lengths: DataFrame, name: str = "n_tokens") -> DataFrame:
    """n_tokens, docs (with this length), docs_from and tokens_from (of this length or more), tokens_cut (all
    texts cut to this length), share_upto (of texts no longer). One row per length that occurs."""
    counts = lengths.groupBy(F.col(name).alias("n_tokens")).agg(F.count("*").alias("docs"))
    counts = Kept(lengths.sparkSession).keep(counts)  # else both uses below would encode all texts
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    tail = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    # one row per 1024 lengths
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in "dt"], *[F.sum(c).over(total).alias(f"all_{c}") for c in "dt"])
    sums = counts.withColumns({"docs_from": F.sum("docs").over(tail), "tokens_from": F.sum("tokens").over(tail)}).join(blocks, "block")
    docs_from, tokens_from = F.col("docs_from") + F.col("later_d"), F.col("tokens_from") + F.col("later_t")
    return sums.select("n_tokens", "docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), (F.col("all_t") - tokens_from + F.col("n_tokens") * docs_from).alias("tokens_cut"),
                       ((F.col("all_d") - docs_from + F.col("docs")) / F.col("all_d")).alias("share_upto"))


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For every limit, also between lengths: texts longer than it, and tokens of all texts cut to it."""
    wide = hist.agg(*[F.struct(F.lit(n).cast("long").alias("context"), F.coalesce(F.sum(F.when(F.col("n_tokens") > n, F.col("docs"))), F.lit(0)).alias("docs_over"),
                               F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(n)) * F.col("docs")), F.lit(0)).alias("tokens_cut")).alias(f"l{n}") for n in limits])
    return wide.select(F.inline(F.array(*[f"l{n}" for n in limits])))


def quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length up to which at least the given share of the texts lies."""
    wide = hist.agg(*[F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("share_upto") >= s - 1e-12, F.col("n_tokens"))).alias("n_tokens")).alias(f"q{i}") for i, s in enumerate(shares)])
    return wide.select(F.inline(F.array(*[f"q{i}" for i in range(len(shares))])))
