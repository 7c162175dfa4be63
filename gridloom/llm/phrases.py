"""Phrase collocations by top-order marginalisation.

Every occurrence of a word starts one window: the word and the next three in lead columns, padded where the piece
ends. Only these longest windows are counted; the number of a shorter phrase is the sum over the windows that it begins,
which a Spark ROLLUP over the columns gives for all lengths at once.

A first pass counts words (their strings are needed anyway). Windows are padded from their first word with less than
``LEAST`` occurrences on, since no phrase of such a word is asked for. Tasks send windows packed by hash range of their first
two words; a range has about ``RANGE_BYTES``, so their number follows the input. There windows of all tasks meet, numbers below
``LEAST`` are given up to the next shorter prefix, and what is left goes to the ROLLUP. Pairs (and triples) that start
more than a 65,536th of all windows are dealt by one word more; at most 131,072 of them are known to every task, as hashes.
The words with enough occurrences are known as a bitmap of ``BITS`` bits; a rare word that it lets through costs a few bytes.

Text null: empty. Language null: ``und``. Empty tables, and languages without a frequent phrase, give no rows. Repeated rows
count repeatedly. Other columns, whatever their names, are ignored. A very long text is one slice of a task.
Words are compared by 64-bit hashes; all sums and scores are exact.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import flat
from gridloom.llm.links import Kept
from gridloom.llm.ranked import LOWER

LEAST, WIDTH, TOP = 30, 4, 2000
#: Words that a task holds before it counts or packs them.
GATHER = 500_000
#: Packed bytes of a hash range, by the estimate of ``WINDOW_BYTES`` a word.
RANGE_BYTES, WINDOW_BYTES = 8 << 20, 24
#: Bytes of text hashed at once; hashing takes about 40 bytes for each.
SLICE = 1 << 20
BITS = 1 << 26
#: Pairs and triples with this share of all windows are dealt by one word more.
HOT = 1 << 16

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09]] = True
_STEP = [flat.U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Words:
    """Words of some rows: language (number in ``langs``), hash, whether the next word is in the same piece, bytes."""

    def __init__(self, batches):
        self.batches, self.langs = batches, {}

    def gathered(self, spelled: bool):
        held, n = [], 0
        for batch in self.batches:
            for part in flat.slices(batch, batch.schema.names[1], SLICE):
                data, offsets = flat.buffers(part.column(1))
                data = LOWER[data]
                starts, ends, first = flat.bounds(data, offsets, SPACE | BREAK)
                h = flat.hashes(data, starts, ends)
                h[h == 0] = flat.U(1)  # 0 stands for no word
                piece = np.r_[0, np.cumsum(BREAK[data])][starts]
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                joined = np.r_[(piece[1:] == piece[:-1]) & (text[1:] == text[:-1]), False][:len(h)]
                names = [self.langs.setdefault(x or "", len(self.langs)) for x in part.column(0).to_pylist()]
                held.append((np.array(names, np.int64)[text], h, joined, (data.tobytes(), starts, ends) if spelled else None))
                n += len(h)
                if n >= GATHER:
                    yield self._all(held)
                    held, n = [], 0
        if held:
            yield self._all(held)

    @staticmethod
    def _all(held):
        lang, h, joined = (np.concatenate([x[k] for x in held]) for k in range(3))
        return lang, h, joined, [x[3] for x in held]

    def names(self) -> list[str]:
        return list(self.langs)

    def salts(self) -> np.ndarray:
        """One number for each language."""
        data, offsets = flat.buffers(pa.array(self.names(), pa.string()))
        return flat.hashes(data, offsets[:-1], offsets[1:])


def _after(h: np.ndarray, linked: np.ndarray) -> list[np.ndarray]:
    """The lead columns: each word and the three after it, 0 from the first gap on."""
    out, open_ = [h], np.ones(len(h), bool)
    for k in range(1, WIDTH):
        open_ = open_[:len(h) - k] & linked[k - 1:len(h) - 1] if k < len(h) else np.zeros(0, bool)
        nxt = np.zeros(len(h), np.uint64)
        nxt[:len(open_)] = np.where(open_, h[k:k + len(open_)], flat.U(0))
        out.append(nxt)
    return out


def _prefixes(salt: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the first 1, 2, 3 and 4 columns with the language."""
    out, h = [], salt
    for step, w in zip(_STEP, words):
        h = flat.mix(h * step + w)
        out.append(h)
    return out


_COUNTS = "lang string, kind int, h long, word binary, n long"


def _count(batches):
    """Words (kind 1) with their numbers; hashes of pairs and triples (2, 3) that start a large share of windows."""
    words = _Words(batches)
    for lang, h, joined, spelled in words.gathered(True):
        salt = words.salts()[lang]
        first = _prefixes(salt, [h])[0]
        _, at, n = np.unique(first, return_index=True, return_counts=True)
        ends = np.cumsum([len(x[1]) for x in spelled])
        which = np.searchsorted(ends, at, "right")
        own = (at - (ends - [len(x[1]) for x in spelled])[which]).tolist()
        names = words.names()
        raw = [spelled[s][0][spelled[s][1][i]:spelled[s][2][i]] for s, i in zip(which.tolist(), own)]
        yield _rows([names[x] for x in lang[at].tolist()], 1, h[at], raw, n)
        least = max(2, len(h) // HOT)
        cols = _after(h, joined)
        keys = _prefixes(salt, cols)
        i = np.flatnonzero(cols[1])
        for kind in (2, 3):
            u, back, n = np.unique(keys[kind - 1][i], return_inverse=True, return_counts=True)
            many = np.flatnonzero(n >= least)
            yield _rows([None] * len(many), kind, u[many], [None] * len(many), n[many])
            i = i[(n >= least)[back]]
            i = i[cols[2][i] > 0]


def _rows(lang, kind, h, word, n):
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(word, pa.binary()), pa.array(n, pa.int64())],
                                      ["lang", "kind", "h", "word", "n"])


_PACKED = "place long, lang string, depth int, pairs binary, sizes binary, tails binary, counts binary"


def _pack(batches, bits: np.ndarray, hot: list[np.ndarray], places: int):
    """Windows of two words and more, packed by hash range, language and depth of the hash."""
    words = _Words(batches)
    for lang, h, joined, _ in words.gathered(False):
        salts = words.salts()
        known = _bit(salts[lang], h)
        known = (bits[known >> 6] >> (known & 63).astype(np.uint64)) & flat.U(1) > 0
        linked = joined & known & np.r_[known[1:], False]
        cols = _after(h, linked)
        i = np.flatnonzero(cols[1])
        lang, cols = lang[i], [c[i] for c in cols]
        keys = _prefixes(salts[lang], cols)
        _, at, n = np.unique(keys[3], return_index=True, return_counts=True)
        lang, cols, keys = lang[at], [c[at] for c in cols], [k[at] for k in keys]
        depth = np.full(len(at), 2)
        for d in (2, 3):
            depth += (depth == d) & _isin(keys[d - 1], hot[d - 2])
        key = np.choose(depth - 2, keys[1:])
        place = ((key >> flat.U(32)) * flat.U(places) >> flat.U(32)).astype(np.int64)
        order = np.lexsort((keys[1], depth, lang, place))
        place, lang, depth, pair = place[order], lang[order], depth[order], keys[1][order]
        cols, n = [c[order] for c in cols], n[order]
        cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (lang[1:] != lang[:-1]) | (depth[1:] != depth[:-1])][:len(place)])
        new = np.r_[True, pair[1:] != pair[:-1]][:len(pair)]
        new[cut] = True
        names, out = words.names(), []
        for a, b in zip(cut.tolist(), np.r_[cut[1:], len(place)].tolist()):
            heads = a + np.flatnonzero(new[a:b])
            out.append((int(place[a]), names[lang[a]], int(depth[a]), np.stack([cols[0][heads], cols[1][heads]]).tobytes(), np.diff(np.r_[heads, b]).astype("<u4").tobytes(),
                        np.stack([cols[2][a:b], cols[3][a:b]]).tobytes(), n[a:b].astype("<u4").tobytes()))
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["place", "lang", "depth", "pairs", "sizes", "tails", "counts"])


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    return (known[np.minimum(at, len(known) - 1)] == values) if len(known) else np.zeros(len(values), bool)


def _bit(salt: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (_prefixes(salt, [h])[0] & flat.U(BITS - 1)).astype(np.int64)


_WINDOWS = "lang string, w1 long, w2 long, w3 long, w4 long, n long"


def _meet(table: pa.Table, least: int) -> pa.Table:
    """Windows of one hash range: numbers below ``least`` go to the next shorter prefix, pairs below it go."""
    found = []
    groups: dict[tuple, list] = {}
    for row in zip(*(table.column(c).to_pylist() for c in ("lang", "depth", "pairs", "sizes", "tails", "counts"))):
        groups.setdefault(row[:2], []).append(row[2:])
    for (lang, depth), rows in groups.items():
        heads = np.concatenate([np.repeat(np.frombuffer(p, "<u8").reshape(2, -1), np.frombuffer(s, "<u4"), axis=1) for p, s, _, _ in rows], axis=1)
        tails = np.concatenate([np.frombuffer(t, "<u8").reshape(2, -1) for _, _, t, _ in rows], axis=1)
        cols = [*heads, *tails]
        n = np.concatenate([np.frombuffer(c, "<u4") for *_, c in rows]).astype(np.int64)
        for length in (4, 3, 2):
            key = _prefixes(np.zeros(1, np.uint64), cols)[length - 1]
            _, at, back = np.unique(key, return_index=True, return_inverse=True)
            total = np.zeros(len(at), np.int64)
            np.add.at(total, back, n)
            if length == 4:  # equal windows of different tasks become one
                cols, n, back, total = [c[at] for c in cols], total, np.arange(len(at)), total
            if length < depth:
                continue
            few = (cols[length - 1] > 0) & (total[back] < least)
            if length == 2:
                cols, n = [c[~few] for c in cols], n[~few]
            else:
                cols = [*cols[:length - 1], *[np.where(few, flat.U(0), c) for c in cols[length - 1:]]]
        key = _prefixes(np.zeros(1, np.uint64), cols)[3]
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, back, n)
        found.append(pa.table([pa.array([lang] * len(at), pa.string()), *[pa.array(c[at].view(np.int64)) for c in cols], pa.array(total)], names=["lang", "w1", "w2", "w3", "w4", "n"]))
    return pa.concat_tables(found)


def _bitmap(words: DataFrame) -> np.ndarray:
    """Bits of the given (lang, h), put together in Spark: at most BITS / 64 numbers."""
    def places(batches):
        for b in batches:
            data, offsets = flat.buffers(b.column(0))
            bit = _bit(flat.hashes(data, offsets[:-1], offsets[1:]), np.asarray(b.column(1)).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array((np.ones(len(bit), np.int64) << (bit & 63)))], ["at", "bits"])

    found = words.select("lang", "h").mapInArrow(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[np.asarray(found.column("at"))] = np.asarray(found.column("bits")).view(np.uint64)
    return out


def count(docs: DataFrame, kept: Kept, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept tables of ``docs`` (lang, text): words (lang, h, word, f) with ``least`` occurrences, phrases (lang, p, f) of
    one to four of them with as many, and totals (lang, n) of all words."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    counts = kept.keep(source.mapInArrow(_count, _COUNTS).groupBy("lang", "kind", "h", "word").agg(F.sum("n").alias("n")))
    every = counts.where("kind = 1")
    totals = kept.keep(every.groupBy("lang").agg(F.sum("n").alias("n")))
    words = kept.keep(every.where(F.col("n") >= least).select("lang", "h", F.col("word").cast("string").alias("word"), F.col("n").alias("f")))
    total = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    share = max(least, total // HOT)
    hot = counts.where(F.col("kind") > 1).where(F.col("n") >= share).select("kind", "h").toArrow()
    kinds, h = np.asarray(hot.column("kind")), np.asarray(hot.column("h")).view(np.uint64)
    shared = spark.sparkContext.broadcast((_bitmap(words), [np.sort(h[kinds == k]) for k in (2, 3)]))
    places = max(1, -(-total * WINDOW_BYTES // RANGE_BYTES))
    packed = source.mapInArrow(lambda b: _pack(b, *shared.value, places), _PACKED)
    windows = packed.groupBy("place").applyInArrow(lambda t: _meet(t, least), _WINDOWS)
    head = F.struct("lang", "w1", "w2").alias("head")
    summed = windows.select(head, "w3", "w4", "n").rollup("head", "w3", "w4").agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    real = (F.col("f") >= least) & ((F.col("level") == 3) | ((F.col("level") == 1) & (F.col("w3") != 0)) | ((F.col("level") == 0) & (F.col("w4") != 0)))
    phrase = F.slice(F.array("head.w1", "head.w2", "w3", "w4"), F.lit(1), F.when(F.col("level") == 3, 2).when(F.col("level") == 1, 3).otherwise(4))
    longer = summed.where(real).select("head.lang", phrase.alias("p"), "f")
    phrases = kept.keep(longer.union(words.select("lang", F.array("h").alias("p"), "f")))
    kept.forget(counts)
    return words, phrases, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    kept = Kept(docs.sparkSession)
    words, phrases, totals = count(docs, kept, least)
    wide = "decimal(38,0)"
    some = phrases.where(F.size("p") > 1).withColumnRenamed("f", "a")
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    cuts = cuts.select("lang", "p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("first"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("rest"))
    for side, number in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("p").alias(side), F.col("f").alias(number)), ["lang", side])
    score = F.expr(f"(cast(2000000 as {wide}) * a) div (cast(l as {wide}) + r)")
    best = cuts.select("lang", "p", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "p", "a").agg(F.min("cut").alias("cut"))
    # phrases inside longer ones
    inner = some.where(F.size("p") > 2).withColumn("from", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.size("p") - 1))).where("`from` + size - 1 <= size(p)")
    outer = inner.groupBy("lang", F.slice("p", F.col("from"), F.col("size")).alias("p")).agg(F.max("a").alias("longer"))
    stay = best.join(outer, ["lang", "p"], "left").where(f"longer is null or cast(100 as {wide}) * longer < cast(80 as {wide}) * a").drop("longer")
    spelled = stay.select("lang", "p", F.posexplode("p").alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    spelled = spelled.groupBy("lang", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = stay.join(spelled, ["lang", "p"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
