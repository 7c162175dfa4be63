"""Near-duplicate detection with DartMinHash signatures and banded joining.

A text is the multiset of its five-word shingles. Each copy of a shingle (its first, second, ... occurrence)
is a region of unit weight into which darts fall as a Poisson process: a dart's rank is the sum of
exponential gaps hashed from shingle, copy and dart number, and a hash gives it a coordinate. A text of W
shingles keeps the darts below a rank of (k ln k + 2k) / W, about that many however long it is, and of these
the earliest per coordinate; texts with an empty coordinate go on with twice the rank. Two texts agree in a
coordinate with the chance of their weighted Jaccard similarity.

Bands of coordinates are joined: at a similarity of 0.8 a pair shares no band with a chance of 5e-5. The
members of a band's bucket are verified against its lead, the member with the most company over all its
bands, by the weighted Jaccard similarity of 32-bit shingle codes. Two members x and y that are not yet connected
need no such check unless their differences from the lead B overlap: with D = x without B and B without x, and
x not linked to B, |x - y| = |Dx| + |Dy| - 2 |Dx & Dy|, which exceeds the ninth of |x| + |y| that a similarity of
0.8 allows (in general (1 - s) / (1 + s)) unless Dx and Dy share enough elements. They share one among the first
of each, rarest first (a prefix filter), so a join on those elements finds every remaining link. A group of
thousands of near copies costs about its size; no pair of it is emitted without such a common edit.

Rows are documents by doc_id: rows with one id are one document, its class joins all their texts. Texts with
the same shingles are copies before anything is joined. A text of 1 to 4 words is one shingle; texts
without words are copies if they are equal as bytes (null is empty). Rows without an id have no class.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import flat
from gridloom.llm.links import Kept, components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Texts that draw their darts together (some 40 to 70 KB of arrays each, however short), and differences that leave a task together.
TEXTS, ELEMENTS = 1024, 1 << 18


def weighted(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each (shingle, copy) of each text, grouped by text, and where each text's begin."""
    h, begin = flat.lower_shingles(texts, width)
    text = np.repeat(np.arange(len(begin) - 1, dtype=np.uint64), np.diff(begin))
    key = np.sort((text << flat.U(40)) | (h >> flat.U(24)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    copy = flat.within(np.diff(np.r_[new, len(key)])).astype(np.uint64)
    return flat.mix((key & flat.U((1 << 40) - 1)) + copy * flat.U(0xA24BAED4963EE407)), begin


def signature(codes: np.ndarray, begin: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Earliest dart of every coordinate, one row per text (zeros for a text without shingles)."""
    n = len(begin) - 1
    out = np.zeros((n, k), np.uint64)
    weight = np.diff(begin)
    for at in range(0, n, TEXTS):
        todo, enough = at + np.flatnonzero(weight[at:at + TEXTS] > 0), k * (math.log(k) + 2)
        while len(todo):
            sizes = weight[todo]
            limit = np.repeat(enough / sizes, sizes)
            element = codes[np.repeat(begin[todo], sizes) + flat.within(sizes)]
            owner = np.repeat(np.arange(len(todo)), sizes)
            rank, number = np.zeros(len(element)), 0
            ranks, cells, darts = [], [], []
            while len(element):
                number += 1
                dart = flat.mix(element + flat.U((number * 0x9FB21C651E98DF25) % 2**64))
                rank = rank - np.log(((dart >> flat.U(11)).astype(float) + 0.5) * 2.0**-53)
                keep = np.flatnonzero(rank < limit)
                element, owner, limit, rank, dart = element[keep], owner[keep], limit[keep], rank[keep], flat.mix(dart[keep] ^ flat.U(0x5851F42D4C957F2D))
                ranks.append(rank), cells.append(owner * k + (dart % flat.U(k)).astype(np.int64)), darts.append(dart)
            ranks, cells, darts = map(np.concatenate, (ranks, cells, darts))
            order = np.argsort(-ranks)  # the earliest is written last
            cells = cells[order]
            got = np.zeros(len(todo) * k, np.uint64)
            hit = np.zeros(len(todo) * k, bool)
            got[cells], hit[cells] = darts[order], True
            full = hit.reshape(-1, k).all(1)
            out[todo[full]] = got.reshape(-1, k)[full]
            todo, enough = todo[~full], enough * 2
    return out


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    n, k = signatures.shape
    parts = signatures.reshape(n, k // rows, rows)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64), (n, k // rows)).copy()
    for r in range(rows):
        key = flat.mix(key * flat.U(0xD1342543DE82EF95) + parts[:, :, r])
    return key


def _sign(batches, width, count, rows):
    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[1]):
            codes, begin = weighted(part.column(1), width)
            data, offsets = flat.buffers(part.column(1))
            prints = []
            raw = flat.hashes(data, offsets[:-1], offsets[1:])
            for seed in (1, 2):  # of the multiset, or of the bytes of a text without words
                total = np.r_[flat.U(0), np.cumsum(flat.mix(codes ^ flat.U(seed)))]
                prints.append(np.where(np.diff(begin) > 0, total[begin[1:]] - total[begin[:-1]], flat.mix(raw + flat.U(seed))).view(np.int64))
            keys = bands(signature(codes, begin, count * rows), rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * count), pa.array(keys.ravel()))
            lists = pa.array([x if m else None for x, m in zip(lists, np.diff(begin) > 0)], pa.list_(pa.int64())) if (np.diff(begin) == 0).any() else lists
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *map(pa.array, prints), lists], ["doc_id", "f1", "f2", "bands"])


def _codes(batches, width):
    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[1]):
            codes, begin = weighted(part.column(1), width)
            text = np.repeat(np.arange(len(begin) - 1, dtype=np.uint64), np.diff(begin))
            key = np.sort((text << flat.U(32)) | (codes >> flat.U(32))) & flat.U(0xFFFFFFFF)
            raw = key.astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([raw[4 * a:4 * b] for a, b in zip(begin.tolist(), begin[1:].tolist())], pa.binary())], ["node", "codes"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted code arrays (copies have codes of their own)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _pairs(batch):
    """Code arrays of both sides of each row."""
    return zip(*([np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(c)] for c in ("codes_a", "codes_b")))


def _verify(batches, least):
    for batch in batches:
        linked = [min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(x, y) >= least for x, y in _pairs(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _differences(batches):
    """What each member b and its lead a don't share, with the sizes."""
    for batch in batches:
        sizes, own, at, held = [], [], 0, 0
        for n, (x, y) in enumerate(_pairs(batch), 1):
            own.append(np.setxor1d(x, y))
            sizes.append((len(x), len(y), len(own[-1])))
            held += len(own[-1])
            if held < ELEMENTS and n < batch.num_rows:
                continue
            sizes = np.array(sizes, np.int32)
            row = np.repeat(np.arange(len(sizes)), sizes[:, 2])
            kept = batch.slice(at, n - at).select(["a", "b", "label", "probe"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(sizes[row, k]) for k in range(3)], pa.array(np.concatenate(own).astype(np.int64))], ["a", "b", "label", "probe", "lead", "size", "apart", "e"])
            sizes, own, at, held = [], [], n, 0


def _with_codes(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    for c in ("a", "b"):
        pairs = pairs.join(codes.select(F.col("node").alias(c), F.col("codes").alias(f"codes_{c}")), c)
    return pairs


def _remaining(pairs: DataFrame, labels: DataFrame, codes: DataFrame, similarity: float, kept: Kept) -> DataFrame:
    """Pairs (a, b) of members of one lead, in different components, whose differences from it overlap enough."""
    named = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("its")), "a", "left").join(labels.select(F.col("node").alias("b"), "label"), "b", "left")
    named = named.select("a", "b", F.coalesce("its", "a").alias("its"), F.coalesce("label", "b").alias("label")).withColumn("probe", F.col("label") != F.col("its"))
    open_ = named.groupBy("a").agg(F.count("*").alias("n"), F.bool_or("probe").alias("some")).where("n > 1 and some").select("a")
    members = named.join(open_, "a", "left_semi").select("a", "b", "label", "probe")
    elements = kept.keep(_with_codes(members, codes).select("a", "b", "label", "probe", "codes_a", "codes_b").mapInArrow(_differences, "a long, b long, label long, probe boolean, lead int, size int, apart int, e long"))
    # an element that one member alone has can't be shared
    often = elements.groupBy("a", "e").agg(F.count("*").alias("often"), F.bool_or("probe").alias("some")).where("often > 1 and some").drop("some")
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("often", "e"))
    s = (1 - similarity) / (1 + similarity)
    # position among all of D, the unshared ones first
    shared = elements.join(often, ["a", "e"]).withColumn("rank", rank)
    count = F.count("*").over(Window.partitionBy("a", "b"))
    shared = shared.withColumn("place", F.col("apart") - count + F.col("rank"))
    least_any = F.floor((F.col("apart") + s * (F.col("lead") - F.col("size"))) / 2 - 1e-6) + 1
    least_probe = F.floor((F.col("apart") - s * (F.col("lead") + F.col("size"))) / 2 - 1e-6) + 1
    shared = shared.withColumns({"any": F.col("place") <= F.col("apart") - F.greatest(least_any, F.lit(1)) + 1, "ask": F.col("probe") & (F.col("place") <= F.col("apart") - F.greatest(least_probe, F.lit(1)) + 1)})
    shared = kept.keep(shared.where("any or ask").select("a", "e", "b", "label", "probe", "size", "apart", "any", "ask", "place"))
    ask = shared.where("ask").select("a", "e", F.col("b").alias("x"), F.col("label").alias("lx"), F.col("size").alias("sx"), F.col("apart").alias("dx"), F.col("any").alias("short"), F.col("place").alias("px"))
    other = shared.where("any").select("a", "e", F.col("b").alias("y"), F.col("label").alias("ly"), F.col("size").alias("sy"), F.col("apart").alias("dy"), F.col("probe").alias("too"), F.col("place").alias("py"))
    need = (F.col("dx") + F.col("dy") - s * (F.col("sx") + F.col("sy"))) / 2 - 1e-6
    # two that both ask meet once, in the shorter prefix of both; if this is the first element they share, what follows must do
    once = ~F.col("too") | (F.col("short") & (F.col("x") < F.col("y")))
    enough = 1 + F.least(F.col("dx") - F.col("px"), F.col("dy") - F.col("py")) >= need
    met = ask.join(other, ["a", "e"]).where(once & enough & (F.col("lx") != F.col("ly")) & (need <= F.least("dx", "dy")) & (F.least("sx", "sy") >= similarity * F.greatest("sx", "sy")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its near-duplicate class)."""
    kept = Kept(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    signed = kept.keep(texts.mapInArrow(lambda b: _sign(b, width, count, rows), "doc_id long, f1 long, f2 long, bands array<long>"))
    kept.bound(signed.count())
    known = signed.where("doc_id is not null")
    groups = kept.keep(known.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    # other ids of a group of copies need no check
    copies = kept.keep(known.select("doc_id", "f1", "f2").join(groups.select("f1", "f2", "node"), ["f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b"))
    keyed = groups.select(F.explode("bands").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("x"), F.max("node").alias("y")).where("x < y")
    live = kept.keep(keyed.join(shared.select("key", "n"), "key"))
    company = live.groupBy("node").agg(F.sum("n").alias("company"))
    kept.forget(signed, groups)
    # a sort-merge join at every size: the members grow with the corpus
    codes = kept.keep(texts.hint("merge").join(company.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(lambda b: _codes(b, width), "node long, codes binary"))
    known = live.join(company, "node")
    lead = known.groupBy("key").agg(F.min(F.struct((-F.col("company")).alias("c"), "node")).alias("lead")).select("key", F.col("lead.node").alias("lead"))
    pairs = kept.keep(live.join(lead, "key").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    tested = kept.keep(_with_codes(pairs, codes).select("a", "b", "codes_a", "codes_b").mapInArrow(lambda b: _verify(b, similarity), "a long, b long, linked boolean").where("linked").select("a", "b"))
    kept.forget(live)
    links = copies.union(tested)
    labels = components(links, kept)
    more = kept.keep(_remaining(pairs, labels, codes, similarity, kept))
    new = _with_codes(more, codes).select("a", "b", "codes_a", "codes_b").mapInArrow(lambda b: _verify(b, similarity), "a long, b long, linked boolean").where("linked").select("a", "b")
    final = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(new), kept)
    kept.forget(copies, codes, pairs, tested, labels, more)
    return docs.select("doc_id").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, **kwargs) -> DataFrame:
    """``docs`` with one row of each class: of its smallest doc_id, the one with the smallest text. Of rows
    without an id one of each text stays. Same columns."""
    found = classes(docs, **kwargs).where("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    rank = flat.fresh(docs, "_rank")
    some = docs.join(found, docs["doc_id"] == F.col("_kept"), "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    none = docs.where("doc_id is null")
    return some.unionByName(none.dropDuplicates(["text"]))
