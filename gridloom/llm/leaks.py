"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Items are grouped into sizes that double. For a group whose largest item has u shingles, texts are cut into
overlapping blocks of 2u shingles, so a short item never drowns in a long text: it lies whole inside a block.
Signatures are one-permutation MinHash with 64u bins: the smallest shingle hash of each bin. An entry that a
block's and an item's signature share makes the text a candidate for the item; the share of the item's
distinct shingles that the whole text holds decides. Items below 8 shingles have a bin for every hash.
(An item with s of its q >= 8 shingles in a block is missed with a chance of about 32^-s.)

A bitmap of all items' shingles, of a bounded size at any number of items, keeps all other shingles from
leaving their task; it may let strangers through, the join on the full hash drops them.

A passage of fewer words than the shingle width is one shingle of all its words, searched at that width; items
without words, null items and null or empty texts never match. ``find`` takes the passages with the same id
for one item, the union of their shingles (of each width); ``drop`` searches every passage on its own, and those
with a null id too if told so. Rows with the same id and words are one row of the result; a null doc_id is an id.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.window import Window

from gridloom.llm import flat
from gridloom.llm.links import Kept

WIDTH, SHARE = 5, 0.8
#: Items below this size have unlimited bins.
SMALL = 8
BINS_PER_SHINGLE = 64
#: log2 of the bits of the filter: at least 256 bits a shingle, within these bounds (8 MB at most).
LEAST_BITS, MOST_BITS = 22, 26

ITEM = "item_id long, width int, h long"
HIT = "doc_id long, f1 long, f2 long, h long, kinds long"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat.buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, first = flat.bounds(data, offsets, flat.NOT_WORD)
    return flat.hashes(data, starts, ends), first


def fingerprints(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words."""
    out = []
    for seed in (3, 5):
        v = flat.mix(words * flat.U(seed)) * (flat.within(np.diff(first)).astype(np.uint64) * flat.U(2) + flat.U(seed))
        total = np.r_[flat.U(0), np.cumsum(flat.mix(v))]
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _shingles(batches, width):
    for batch in batches:
        words, first = _words(batch.column(1))
        ids = batch.column(0).to_pylist()
        for k, item in enumerate(ids):
            own = words[first[k]:first[k + 1]]
            if item is None or not len(own):
                continue
            w = min(width, len(own))
            h = np.unique(flat.rolling(own, np.array([0, len(own)]), w)[0])
            n = len(h)
            yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([w] * n, pa.int32()), pa.array(h.view(np.int64))], ["item_id", "width", "h"])


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, width, h, q (distinct shingles of the item), kind (its group: sizes to 2^kind - 1), listed (h is in the signature)."""
    h = benchmark.select("item_id", "text").mapInArrow(lambda b: _shingles(b, width), ITEM).distinct()
    sizes = h.groupBy("item_id", "width").agg(F.count("*").cast("int").alias("q")).withColumn("kind", F.length(F.bin("q")))
    items = h.join(sizes, ["item_id", "width"])
    place = F.expr(f"h & (shiftleft({BINS_PER_SHINGLE}L, kind) - 1)")
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    least = F.min(unsigned).over(Window.partitionBy("item_id", "width", place))
    return items.withColumn("listed", (F.col("q") < SMALL) | (unsigned == least)).select("item_id", "width", "h", "q", "kind", "listed")


def _block_minima(h: np.ndarray, begin: np.ndarray, kind: int) -> np.ndarray:
    """Whether a position has the smallest hash of its bin in a block that holds it."""
    size = 2 << kind
    position = flat.within(np.diff(begin))
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    bins = h % flat.U(BINS_PER_SHINGLE << kind)
    least = np.zeros(len(h), bool)
    for shift in (0, size // 2):
        block = (position + shift) // size
        order = np.lexsort((h, bins, block, text))
        t, b, s = text[order], block[order], bins[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1])]
        run = np.cumsum(new) - 1
        least[order] |= h[order] == h[order][np.flatnonzero(new)][run]
    return least


def _hits(batches, bitmap, bits, width, kinds, needed):
    mask = flat.U((1 << bits) - 1)
    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[1]):
            words, first = _words(part.column(1))
            h, begin = flat.rolling(words, first, width)
            at = (h & mask).astype(np.int64)
            kept = np.flatnonzero((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if not len(kept):
                continue
            text = np.searchsorted(begin, kept, "right") - 1
            key = np.unique((text.astype(np.uint64) << flat.U(40)) | (h[kept] >> flat.U(24)))
            found = np.bincount((key >> flat.U(40)).astype(np.int64), minlength=len(first) - 1)
            rows = np.flatnonzero(found >= needed)
            if not len(rows):
                continue
            sizes = begin[rows + 1] - begin[rows]
            own = h[np.repeat(begin[rows], sizes) + flat.within(sizes)]
            cut = np.r_[0, np.cumsum(sizes)]
            where = (own & mask).astype(np.int64)
            stays = np.flatnonzero((bitmap[where >> 3] >> (where & 7).astype(np.uint8)) & 1)
            marks = np.full(len(stays), 0, np.int64)
            for kind in kinds:
                marks |= _block_minima(own, cut, kind)[stays].astype(np.int64) << kind
            f1, f2 = fingerprints(words, first)
            text = rows[np.searchsorted(cut, stays, "right") - 1]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()).take(pa.array(text)), pa.array(f1[text]), pa.array(f2[text]), pa.array(own[stays].view(np.int64)), pa.array(marks)], ["doc_id", "f1", "f2", "h", "kinds"])


def _bitmap(items: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The items' hashes modulo 2^bits as a bit field, gathered as at most 2^(MOST_BITS - 6) words."""
    bits = min(max(LEAST_BITS, (256 * n).bit_length()), MOST_BITS)
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = items.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    field = np.zeros(1 << (bits - 6), np.int64)
    field[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return field.view(np.uint8), bits


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """One row per text and benchmark item of which it holds at least ``share``: doc_id, f1, f2 (hashes of
    the text's words), item_id, n_shingles, n_found."""
    spark = docs.sparkSession
    items = Kept(spark).keep(_items(benchmark, width))
    groups = items.groupBy("width", "kind").agg(F.count("*").alias("n"), F.min("q").alias("q")).collect()  # a few widths and doublings
    parts = []
    for w in sorted({g["width"] for g in groups}):
        own = [g for g in groups if g["width"] == w]
        mine = items.where(F.col("width") == w)
        field, bits = _bitmap(mine, sum(g["n"] for g in own))
        shared = spark.sparkContext.broadcast(field)
        kinds = sorted({g["kind"] for g in own if g["q"] >= SMALL or (1 << g["kind"]) > SMALL})
        needed = max(1, int(np.ceil(share * min(g["q"] for g in own) - 1e-9)))
        hits = docs.select("doc_id", "text").mapInArrow(lambda b, s=shared, n=bits, v=w, k=kinds, m=needed: _hits(b, s.value, n, v, k, m), HIT)
        seen = F.col("listed") & ((F.col("q") < SMALL) | (F.expr("shiftright(kinds, kind) & 1L") == 1))
        parts.append(hits.join(mine, "h").groupBy("doc_id", "f1", "f2", "item_id", "h").agg(F.max("q").alias("q"), F.bool_or(seen).alias("seen"))
                     .groupBy("doc_id", "f1", "f2", "item_id").agg(F.max("q").alias("n_shingles"), F.count("*").cast("int").alias("n_found"), F.bool_or("seen").alias("seen"))
                     .where(F.col("seen") & (F.col("n_found") >= F.lit(share) * F.col("n_shingles"))).drop("seen"))
    if not parts:
        return spark.createDataFrame([], "doc_id long, f1 long, f2 long, item_id long, n_shingles int, n_found int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def drop(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE, unnamed: bool = False) -> DataFrame:
    """``docs`` without the rows whose text holds a passage of the benchmark, each row of which is searched on its
    own; ``unnamed``: those without an id too. Same columns."""
    rows = benchmark if unnamed else benchmark.where("item_id is not null")
    passages = rows.where("text is not null").select(F.xxhash64("text").alias("item_id"), "text")
    bad = find(docs, passages, width, share).select(F.col("f1").alias("_b1"), F.col("f2").alias("_b2")).distinct()
    a, b = flat.fresh(docs, "_f1"), flat.fresh(docs, "_f2")
    long = (T.LongType(), pa.int64())
    marked = flat.with_columns(docs, "text", {a: long, b: long}, lambda: lambda t: list(fingerprints(*_words(t))))
    return marked.join(bad, (F.col(a) == F.col("_b1")) & (F.col(b) == F.col("_b2")), "left_anti").select(*docs.columns)
