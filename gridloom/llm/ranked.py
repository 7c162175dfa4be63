"""Ranked lexical search over a length-stratified index.

Documents with one normaliser m = 100 - 25 + (25 n N) div L form a stratum: there the impact of an occurrence
count tf, (1000000000 tf) div (1000 tf + 12 m), is one number, computed once per tf. A stratum is stored as
blocks of about ``BLOCK_TERMS`` terms (a stratum with a third of all rows is many blocks, one very long document is one),
each with its postings grouped by (term, tf). The greatest tf of each term bounds what an item can score in a block.

A search makes three passes over the index: the bounds alone give each item its k best blocks; their documents give
a score that k documents reach; then every block whose bound is not below it is visited, best bound first, and the score
to reach rises as documents are found. No document that could enter, ties included, lies in a block left out, so the
ranking is exact. Items go to the tasks in parts of about ``PART_TERMS`` (item, term) entries, 16 bytes each.

Every row of ``docs`` is a document of its own, also when ids repeat; null ids rank before others among equal scores.
Null, empty and term-less texts are no documents. Rows of ``items`` with one id (null is an id too) are one item, repeats
counted. Other columns are ignored, whatever their names. Empty tables give no rows. Terms are compared by 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import flat
from gridloom.llm.links import Kept

#: Terms of a block; a longer document is a block of its own.
BLOCK_TERMS = 1 << 18
#: (item, term) entries that a task gets at once.
PART_TERMS = 1 << 19
#: Contributions, or cells of scores, that are held at once.
CELLS = 1 << 22

NOT_TERM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


class Index(NamedTuple):
    blocks: DataFrame
    docs: int
    terms: int
    kept: Kept


class Part(NamedTuple):
    """Items of one part: entries (item, weight) grouped by term; ``names`` are their ids."""
    vocabulary: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    names: pa.Array


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat.buffers(texts)
    data = LOWER[data]
    starts, ends, first = flat.bounds(data, offsets, NOT_TERM)
    return flat.hashes(data, starts, ends), first


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text once, in order, with their counts, and where each text's begin."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][:len(h)])
    return h[new], np.diff(np.r_[new, len(h)]), np.searchsorted(text[new], np.arange(len(first)))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[0]):
            data, offsets = flat.buffers(part.column(0))
            n = np.diff(flat.bounds(data, offsets, NOT_TERM)[2])
            yield pa.RecordBatch.from_arrays([pa.array(n[n > 0], pa.int64())], ["n"])


def normaliser(n: int, docs: int, terms: int) -> int:
    return 100 - 25 + (25 * n * docs) // terms


def _postings(batches, docs, terms):
    row = 0
    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[1]):
            h, first = _terms(part.column(1))
            term, tf, begin = _distinct(h, first)
            tf = tf.astype("<i4")
            n = np.diff(first)
            some = np.flatnonzero(n > 0)
            ids = part.column(0).cast(pa.int64())
            salt = flat.mix(np.asarray(pc.fill_null(ids, 0)).view(np.uint64) * flat.U(0x9E3779B97F4A7C15) + np.arange(row, row + len(n)).astype(np.uint64)) >> flat.U(1)
            row += len(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([normaliser(x, docs, terms) for x in n[some].tolist()], pa.int64()), pa.array(salt[some].view(np.int64)), ids.take(pa.array(some)),
                *[pa.array([v[a:b].tobytes() for a, b in zip(begin[some].tolist(), begin[some + 1].tolist())], pa.binary()) for v in (term, tf)]],
                ["m", "salt", "doc_id", "terms", "tfs"])


_BLOCK = "m long, block long, docs array<long>, terms binary, tfs binary, sizes binary, places binary"


def _block(key, table: pa.Table) -> pa.Table:
    """One block: documents by id, postings by (term, tf)."""
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
    terms, tfs = ([np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("terms", "<u8"), ("tfs", "<i4")))
    place = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
    term, tf = np.concatenate(terms), np.concatenate(tfs)
    order = np.lexsort((place, tf, term))
    term, tf, place = term[order], tf[order], place[order]
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
    sizes = np.diff(np.r_[new, len(term)]).astype("<i4")
    ids = table.column("doc_id").to_pylist()
    return pa.table({
        "m": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()), "docs": pa.array([ids], pa.list_(pa.int64())),
        "terms": [term[new].tobytes()], "tfs": [tf[new].tobytes()], "sizes": [sizes.tobytes()], "places": [place.astype("<u2" if len(ids) <= 1 << 16 else "<u4").tobytes()]})


def build(docs: DataFrame) -> Index:
    """Index of every row of ``docs`` (doc_id, text) with a term."""
    kept = Kept(docs.sparkSession)
    lengths = kept.keep(docs.select("text").mapInArrow(_lengths, "n long").groupBy("n").agg(F.count("*").alias("docs")))
    n_docs, n_terms = lengths.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum(F.col("n").cast("decimal(38,0)") * F.col("docs")), F.lit(0))).first()
    n_docs, n_terms = int(n_docs), int(n_terms)
    size = F.col("n").cast("decimal(38,0)")
    strata = kept.keep(lengths.select(F.expr(f"75 + (cast(25 * n as decimal(38,0)) * {n_docs}) div {max(n_terms, 1)}").cast("long").alias("m"), (size * F.col("docs")).alias("terms"))
                       .groupBy("m").agg(F.ceil(F.sum("terms") / BLOCK_TERMS).cast("long").alias("blocks")))
    rows = docs.select("doc_id", "text").mapInArrow(lambda b: _postings(b, n_docs, n_terms), "m long, salt long, doc_id long, terms binary, tfs binary")
    placed = rows.join(strata, "m").select("m", F.expr("pmod(salt, blocks)").alias("block"), "doc_id", "terms", "tfs")
    blocks = kept.keep(placed.groupBy("m", "block").applyInArrow(lambda key, rows: _block(key, rows), _BLOCK))
    kept.forget(lengths, strata)
    return Index(blocks, n_docs, n_terms, kept)


def _asked(batches, kind):
    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[1]):
            term, tf, begin = _distinct(*_terms(part.column(1)))
            ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(begin))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(term.view(np.int64)), pa.array(tf, pa.int64())], ["item_id", "term", "n"])


def _known(raw: bytes, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of a block the vocabulary has, and their places in it."""
    terms = np.frombuffer(raw, "<u8")
    at = np.searchsorted(vocabulary, terms)
    at[at == len(vocabulary)] = 0
    hit = np.flatnonzero(vocabulary[at] == terms) if len(vocabulary) else np.zeros(0, np.int64)
    return hit, at[hit]


def _frequencies(batches, vocabulary):
    total = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        for terms, sizes in zip(*(batch.column(c).to_pylist() for c in ("terms", "sizes"))):
            hit, at = _known(terms, vocabulary)
            np.add.at(total, at, np.frombuffer(sizes, "<i4")[hit])
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["v", "df"])


def _impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """Impact of each tf in a stratum, each different tf once."""
    each, where = np.unique(tf, return_inverse=True)
    each = each.astype(np.int64)
    return ((1_000_000_000 * each) // (1000 * each + 12 * m))[where]


def _spread(begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries of groups ``at``: the entry's own number, and the places of its group's members."""
    sizes = begin[at + 1] - begin[at]
    return np.repeat(np.arange(len(at)), sizes), np.repeat(begin[at], sizes) + flat.within(sizes)


def _bound(m: int, terms: bytes, tfs: bytes, part: Part) -> np.ndarray:
    """The most that each item can score in a block."""
    hit, at = _known(terms, part.vocabulary)
    last = np.flatnonzero(np.r_[at[1:] != at[:-1], True][:len(at)])  # the greatest tf of a term comes last
    impact = _impacts(np.frombuffer(tfs, "<i4")[hit[last]], m)
    entry, member = _spread(part.begin, at[last])
    out = np.zeros(len(part.names), np.int64)
    np.add.at(out, part.item[member], part.weight[member] * impact[entry])
    return out


class _Best:
    """The k best rows of each item: highest score, then null id, then smallest id."""

    def __init__(self, items: int, k: int, least: np.ndarray):
        self.k, self.least = k, np.maximum(least, 1)
        self.rows = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        self.more: list = []
        self.n = 0

    def add(self, item, score, doc, named) -> None:
        self.more.append((item, score, doc, named))
        self.n += len(item)
        if self.n > CELLS // 16:
            self.settle()

    def settle(self) -> None:
        item, score, doc, named = (np.concatenate(x) for x in zip(self.rows, *self.more))
        order = np.lexsort((doc, named, -score, item))
        rank = flat.within(np.unique(item, return_counts=True)[1])
        order = order[rank < self.k]
        self.rows = [x[order] for x in (item, score, doc, named)]
        full = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.least[self.rows[0][full]] = np.maximum(self.least[self.rows[0][full]], self.rows[1][full])
        self.more, self.n = [], 0


def _top_bounds(batches, part: Part, k):
    best = _Best(len(part.names), k, np.ones(len(part.names), np.int64))
    for batch in batches:
        for m, terms, tfs in zip(*(batch.column(c).to_pylist() for c in ("m", "terms", "tfs"))):
            bound = _bound(m, terms, tfs, part)
            item = np.flatnonzero(bound >= best.least)
            best.add(item, bound[item], np.zeros(len(item), np.int64), np.ones(len(item), bool))
    best.settle()
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows[:2]], ["item", "score"])


def _scores(row: dict, part: Part, chosen: np.ndarray):
    """(item, score, place) of the documents of a block with a positive score, for the chosen items."""
    hit, at = _known(row["terms"], part.vocabulary)
    sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    places = np.frombuffer(row["places"], "<u2" if len(row["docs"]) <= 1 << 16 else "<u4")
    impact = _impacts(np.frombuffer(row["tfs"], "<i4")[hit], row["m"])
    slot = np.full(len(part.names), -1)
    slot[chosen] = np.arange(len(chosen))
    entry, member = _spread(part.begin, at)
    keep = slot[part.item[member]] >= 0
    entry, member = entry[keep], member[keep]
    order = np.argsort(slot[part.item[member]], kind="stable")
    entry, member = entry[order], member[order]
    mine, gain, length = slot[part.item[member]], part.weight[member] * impact[entry], sizes[hit[entry]]
    width = len(row["docs"])
    step = max(1, CELLS // width)
    for a in range(0, len(chosen), step):
        score = np.zeros(min(step, len(chosen) - a) * width, np.int64)
        lo, hi = np.searchsorted(mine, [a, a + step])
        done = np.cumsum(length[lo:hi])
        while lo < hi:
            upto = lo + max(1, int(np.searchsorted(done - (done[0] - length[lo]), CELLS, "right")))
            n = length[lo:upto]
            place = places[np.repeat(starts[hit[entry[lo:upto]]], n) + flat.within(n)]
            np.add.at(score, np.repeat((mine[lo:upto] - a) * width, n) + place, np.repeat(gain[lo:upto], n))
            done, lo = done[upto - lo:], upto
        found = np.flatnonzero(score)
        yield chosen[a + found // width], score[found], found % width


def _visit(batches, part: Part, k, cut):
    best = _Best(len(part.names), k, cut)
    for batch in batches:
        rows = batch.to_pylist()
        bounds = [_bound(r["m"], r["terms"], r["tfs"], part) for r in rows]
        for r in sorted(range(len(rows)), key=lambda r: -int(bounds[r].max(initial=0))):
            chosen = np.flatnonzero(bounds[r] >= best.least)
            if not len(chosen):
                continue
            ids = rows[r]["docs"]
            named = np.array([x is not None for x in ids])
            doc = np.array([x or 0 for x in ids], np.int64)
            for item, score, place in _scores(rows[r], part, chosen):
                good = score >= best.least[item]
                best.add(item[good], score[good], doc[place[good]], named[place[good]])
            best.settle()
    best.settle()
    item, score, doc, named = best.rows
    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc, mask=~named)], ["item", "score", "doc_id"])


def _kth(rows: DataFrame, k: int, items: int) -> np.ndarray:
    """The k-th highest score of each item, 1 where there are fewer."""
    out = np.ones(items, np.int64)
    order = Window.partitionBy("item").orderBy(F.col("score").desc())
    for item, score in rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where(F.col("rank") == k).select("item", "score").collect():
        out[item] = score
    return out


def _part(rows: pa.Table, index: Index) -> Part | None:
    """The part's items with the weight of each term, terms of no weight left out."""
    ids = pc.dictionary_encode(rows.column("item_id").combine_chunks(), null_encoding="encode")
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    item, term, n = np.asarray(ids.indices), np.asarray(rows.column("term")).view(np.uint64), np.asarray(rows.column("n"))
    vocabulary, v = np.unique(term, return_inverse=True)
    df = np.zeros(len(vocabulary), np.int64)
    found = index.blocks.select("terms", "sizes").mapInArrow(lambda b: _frequencies(b, vocabulary), "v long, df long").groupBy("v").agg(F.sum("df").alias("df"))
    for at, docs in found.collect():
        df[at] = docs
    weight = np.floor(1000 * np.log((2 * index.docs + 2) / (2 * df + 1))).astype(np.int64)
    weight[df == 0] = 0
    order = np.argsort(v, kind="stable")
    order = order[weight[v[order]] > 0]
    used, begin = np.unique(v[order], return_index=True)
    if not len(used):
        return None
    return Part(vocabulary[used], np.r_[begin, len(order)], item[order], weight[v[order]] * n[order], ids.dictionary)


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of each item (item_id, text): item_id, rank, doc_id, score."""
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").mapInArrow(lambda b: _asked(b, kind), f"item_id {kind}, term long, n long")
    asked = index.kept.keep(asked.groupBy("item_id", "term").agg(F.sum("n").alias("n")))
    parts = -(-asked.count() // PART_TERMS)
    out = None
    for p in range(parts):
        part = _part(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).toArrow(), index)
        if part is None:
            continue
        count = len(part.names)
        shared = index.blocks.sparkSession.sparkContext.broadcast(part)
        first = _kth(index.blocks.select("m", "terms", "tfs").mapInArrow(lambda b, s=shared: _top_bounds(b, s.value, k), "item long, score long"), k, count)

        def visit(cut, s=shared):
            return index.blocks.mapInArrow(lambda b: _visit(b, s.value, k, cut), "item long, score long, doc_id long")

        rows = visit(_kth(visit(first), k, count))
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        def name(batches, s=shared):
            for b in batches:
                yield pa.RecordBatch.from_arrays([s.value.names.take(b.column("item")), b.column("rank"), b.column("doc_id"), b.column("score")], ["item_id", "rank", "doc_id", "score"])

        ranked = ranked.select("item", "rank", "doc_id", "score").mapInArrow(name, f"item_id {kind}, rank int, doc_id long, score long")
        out = ranked if out is None else out.union(ranked)
    if out is None:
        out = index.blocks.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
