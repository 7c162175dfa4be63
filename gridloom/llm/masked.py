"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both of its sides.

Words are classes: the most frequent words of the whole corpus have one each, the others share a fourth of the classes
by hash; the number of classes grows with the square root of the number of distinct words. Inside a shared class a
word has its exact share of the class' occurrences in the corpus, so P(word | sides) = P(class | sides) n(word) / n(class).
A network with one hidden layer sees the two classes before and the two after a place and predicts the class
in two steps (a group of classes, then the class inside it). It starts from the corpus' class frequencies;
each task then trains a copy on the masked places of all its texts (every sixth, from a different place in
every text) and the copies are averaged by the places they saw. Six such rounds, each from the averaged weights and
with the next places, mask every word of every text once. The texts' classes are written once for all rounds. A text's score is the sum, over all
its words, of the log probability of the word given both sides. The counts n are a table: the ``KNOWN`` most frequent
words travel with the model, a text's other words of shared classes are joined to the table.

Words are lower-cased runs of ASCII letters, digits, underscores and non-ASCII characters. Texts without
words, and null texts, have score 0 and a null mean. Repeated texts get equal scores and count as often as
they occur.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import flat
from gridloom.llm.links import Kept

#: The smallest network; ``groups`` says how many groups of as many classes a corpus gets.
GROUP = 32
CLASSES, TAIL = GROUP * GROUP, 256
KNOWN = 1 << 16
SIDE, HIDDEN = (-2, -1, 1, 2), 16
MASK_EVERY, BATCH, RATE, ROW_RATE = 6, 512, 0.5, 0.05
CHUNK = 1 << 11


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat.buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, first = flat.bounds(data, offsets, flat.NOT_WORD)
    return flat.hashes(data, starts, ends), first


def groups(words: int) -> int:
    """Groups, and classes in each, for so many distinct words: about 2.25 sqrt(words) classes."""
    return max(GROUP, int(np.ceil(1.5 * words**0.25)))


def _tail(group: int) -> int:
    """Shared classes: a power of two, a fourth of the classes or less."""
    return 1 << ((group * group // 4).bit_length() - 1)


def _find(sorted_: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in ``sorted_`` (not empty), and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)
    return at, sorted_[at] == hashes


def _count(batches):
    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[0]):
            words, counts = np.unique(_hashes(part.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts, pa.int64())], ["h", "n"])


class Network:
    """Word classes, and the weights as one flat vector with named views."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, group: int = GROUP):
        self.words, self.weights, self.size = words, weights, group
        self.outside, self.shared = group * group, _tail(group)
        self.room = (np.zeros((0, 0), np.float32),)
        self.order = np.argsort(words)
        self.sorted = words[self.order]
        at = 0
        for name, shape in self.shapes(group).items():
            size = int(np.prod(shape))
            setattr(self, name, weights[at:at + size].reshape(shape))
            at += size
        # each layer with its biases below its weights: to_group and group, to_class and inner
        self.one, self.two = (weights[first:last].reshape(-1, group) for first, last in ((at - (2 * HIDDEN + 1 + group) * group, at - (HIDDEN + group) * group), (at - (HIDDEN + group) * group, at)))

    @staticmethod
    def shapes(group: int) -> dict[str, tuple[int, ...]]:
        return {"rows": (len(SIDE), group * group + 1, HIDDEN), "hidden": (HIDDEN,), "to_group": (HIDDEN, group), "group": (group,), "to_class": (HIDDEN, group), "inner": (group, group)}

    @classmethod
    def start(cls, words: np.ndarray, frequency: np.ndarray) -> Network:
        group = int(np.sqrt(len(frequency)))
        size = sum(int(np.prod(s)) for s in cls.shapes(group).values())
        net = cls(words, np.random.default_rng(7).normal(0, 0.1, size).astype(np.float32), group)
        table = (frequency + 0.5).reshape(group, group)
        net.hidden[:] = 0
        net.group[:] = np.log(table.sum(1) / table.sum())
        net.inner[:] = np.log(table / table.sum(1, keepdims=True))
        return net

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        shared = self.outside - self.shared + (hashes % flat.U(self.shared)).astype(np.int64)
        if not len(self.sorted):
            return shared
        at, there = _find(self.sorted, hashes)
        return np.where(there, self.order[at], shared)

    def forward(self, around: np.ndarray, word: np.ndarray):
        """Log probability of the class at every place, what goes into both layers, and both layers' logits less their
        largest, as exponentials with their sums. One column per place, so that sums run along rows. A layer's input is
        the hidden layer and a 1 for each bias that counts: of the one group layer, or of the word's group. All but the
        first hold until the next call."""
        table, step = self.rows.reshape(-1, HIDDEN), self.outside + 1
        z = self.hidden + table[around[0]]
        for s in range(1, len(SIDE)):
            z += table[around[s] + s * step]
        group, inside = np.divmod(word, self.size)
        each = np.arange(len(word))
        if self.room[0].shape[1] != len(word):  # kept from batch to batch: new pages cost as much as the sums
            self.room = [np.ones((n, len(word)), np.float32) for n in (HIDDEN + 1, HIDDEN + self.size, self.size, self.size)]
        left, right, one, two = self.room
        np.tanh(z.T, out=left[:HIDDEN])
        right[:HIDDEN] = left[:HIDDEN]
        right[HIDDEN:] = 0
        right[HIDDEN + group, each] = 1
        np.matmul(self.one.T, left, out=one)
        np.matmul(self.two.T, right, out=two)
        logs, totals = np.zeros(len(word), np.float32), []
        for logits, target in ((one, group), (two, inside)):
            logits -= logits.max(0)
            logs += logits[target, each]
            total = np.exp(logits, out=logits).sum(0)
            logs -= np.log(total)
            totals.append(total)
        return logs, left, right, one, two, totals

    def learn(self, around: np.ndarray, word: np.ndarray) -> None:
        _, left, right, one, two, totals = self.forward(around, word)
        each, rate = np.arange(len(word)), np.float32(RATE / len(word))
        group, inside = np.divmod(word, self.size)
        for layer, target, total in ((one, group, totals[0]), (two, inside, totals[1])):
            layer /= total
            layer[target, each] -= 1
        h = left[:HIDDEN]
        back = (self.to_group @ one + self.to_class @ two) * (1 - h * h)
        self.one -= rate * (left @ one.T)
        # a product with the 1 of each word's group adds up the rows of ``inner``
        step = right @ two.T
        step[:HIDDEN] *= rate
        step[HIDDEN:] *= np.float32(ROW_RATE)
        self.two -= step
        self.hidden -= rate * back.sum(1)
        # repeated rows add up; numpy is faster at it in one dimension
        values = (np.float32(ROW_RATE) * back.T).ravel()
        for s in range(len(SIDE)):
            np.subtract.at(self.rows[s].reshape(-1), (around[s][:, None] * HIDDEN + np.arange(HIDDEN)).ravel(), values)


def _padded(word: np.ndarray, first: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes with places of the class ``outside`` around every text, and where each word went."""
    sizes = np.diff(first)
    to = np.arange(len(word)) + max(SIDE) * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    out = np.full(len(word) + max(SIDE) * (len(sizes) + 1), outside, np.int64)
    out[to] = word
    return out, to


def _sides(padded: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Classes around the places ``to``, one row per side."""
    return padded[to + np.array(SIDE)[:, None]]


def _class_type(group: int) -> np.dtype:
    return np.dtype("<u2" if group * group < 1 << 16 else "<u4")


def _classes(batches, words, weights, group):
    """Classes of all words of each slice, and where its texts begin, as bytes."""
    net = Network(words, weights, group)
    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[0]):
            hashes, first = _hashes(part.column(0))
            if len(hashes):
                word = net.classes(hashes).astype(_class_type(group))
                yield pa.RecordBatch.from_arrays([pa.array([word.tobytes()], pa.binary()), pa.array([first.astype("<i8").tobytes()], pa.binary())], ["word", "first"])


def _masked(word: np.ndarray, first: np.ndarray, turn: int) -> np.ndarray:
    """The places of a round, in a mixed order."""
    sizes = np.diff(first)
    at = np.flatnonzero((flat.within(sizes) + np.repeat(sizes, sizes) + turn) % MASK_EVERY == 0)
    return at[np.argsort(flat.mix(at.astype(np.uint64) * flat.U(0x9E3779B97F4A7C15) ^ word[at].astype(np.uint64)), kind="stable")]


def _train(batches, words, weights, group, turn):
    """Weights of this task's copy in rows of HIDDEN, and the places it saw."""
    # a new array: numpy adds at places slowly (some 18 times) to one with the dtype object that comes with a pickled one
    own_weights = np.empty(len(weights), np.float32)
    own_weights[:] = weights
    net, seen = Network(words, own_weights, group), 0
    for batch in batches:
        for raw, begin in zip(batch.column(0), batch.column(1)):
            word, first = np.frombuffer(raw.as_buffer(), _class_type(group)).astype(np.int64), np.frombuffer(begin.as_buffer(), "<i8")
            at = _masked(word, first, turn)
            padded, to = _padded(word, first, net.outside)
            for k in range(0, len(at), BATCH):
                own = at[k:k + BATCH]
                net.learn(_sides(padded, to[own]), word[own])
            seen += len(at)
    if seen:
        rows = np.r_[net.weights, np.zeros(-len(net.weights) % HIDDEN, np.float32)].reshape(-1, HIDDEN)
        columns = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(HIDDEN)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), seen)), *columns], ["k", "seen", *[f"w{i}" for i in range(HIDDEN)]])


def count(docs: DataFrame, kept: Kept, text: str = "text") -> DataFrame:
    """h (hash), n: how often each word occurs in all texts, as a kept table."""
    return kept.keep(docs.select(text).mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))


def _totals(counts: DataFrame, top, group: int) -> np.ndarray:
    """Occurrences of every class: of the words ``top``, and of all others of each shared class."""
    shared = _tail(group)
    own = group * group - shared
    totals = counts.groupBy(F.expr(f"cast(h & {shared - 1} as int)").alias("tail")).agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(group * group)
    frequency[:len(top)] = top["n"]
    frequency[own + totals["tail"].to_numpy(np.int64)] = totals["n"]
    np.subtract.at(frequency, own + (top["h"].to_numpy(np.int64) & (shared - 1)), top["n"].to_numpy(float))
    return frequency


def _common(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of all words from a count on that at most ``most`` words reach."""
    level = F.floor(16 * F.log2("n"))
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()  # 16 a doubling
    within = [r["level"] for r, words in zip(levels, np.cumsum([r["words"] for r in levels])) if words <= most]
    if not within:
        return np.zeros(0, np.uint64), np.zeros(0)
    found = counts.where(level >= within[-1]).toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["n"].to_numpy(float)[order]


def train(docs: DataFrame, text: str = "text", rounds: int = MASK_EVERY, counts: DataFrame | None = None) -> Network:
    """Train on all texts from the counts of their words (``count``); after MASK_EVERY rounds every word has been
    masked once. Only the model reaches the driver."""
    kept = Kept(docs.sparkSession)
    counts = count(docs, kept, text) if counts is None else counts
    group = groups(counts.count())
    top = counts.orderBy(F.desc("n"), "h").limit(group * group - _tail(group)).toPandas()
    frequency = _totals(counts, top, group)
    net = Network.start(top["h"].to_numpy(np.int64).view(np.uint64), frequency)
    texts = kept.keep(docs.select(text).mapInArrow(lambda b, w=net.words, v=net.weights: _classes(b, w, v, group), "word binary, first binary"))
    names = [f"w{i}" for i in range(HIDDEN)]
    for turn in range(rounds):
        now = net
        copies = texts.mapInArrow(lambda b, w=now.words, v=now.weights, t=turn: _train(b, w, v, group, t), f"k long, seen long, {', '.join(f'{c} float' for c in names)}")
        mean = copies.groupBy("k").agg(*[(F.sum(F.col(c).cast("double") * F.col("seen")) / F.sum("seen")).alias(c) for c in names]).toPandas()
        if len(mean):
            weights = np.zeros((-(-len(now.weights) // HIDDEN), HIDDEN), np.float32)
            weights[mean["k"].to_numpy()] = mean[names].to_numpy(np.float32)
            net = Network(now.words, weights.ravel()[:len(now.weights)].copy(), group)
    kept.forget(texts)
    net.frequency = frequency
    return net


def _runs(net: Network, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log probability of the class at every place."""
    logs = np.zeros(len(word))
    padded, to = _padded(word, first, net.outside)
    for k in range(0, len(word), CHUNK):
        own = slice(k, k + CHUNK)
        logs[own] = net.forward(_sides(padded, to[own]), word[own])[0]
    return logs


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values)]
    return np.where(np.diff(first) > 0, total[first[1:]] - total[first[:-1]], 0.0)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def score(docs: DataFrame, net: Network, text: str = "text", counts: DataFrame | None = None, known: int = KNOWN) -> DataFrame:
    """``docs`` with n_tokens, log_likelihood (sum over all words) and mean_log_likelihood. Without ``counts`` a word
    of a shared class counts as its class. With the counts it was trained from it counts as itself, and a
    word that the corpus lacks as if it had it once; then the result is without the text."""
    words, weights, group = net.words, net.weights, net.size
    double, long = (T.DoubleType(), pa.float64()), (T.LongType(), pa.int64())
    if counts is None:
        def make():
            own = Network(words, weights, group)

            def work(texts):
                hashes, first = _hashes(texts)
                sums, sizes = _sums(_runs(own, own.classes(hashes), first), first), np.diff(first)
                return [sizes, sums, pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)]

            return work

        return flat.with_columns(docs, text, {"n_tokens": long, "log_likelihood": double, "mean_log_likelihood": double}, make)

    totals = np.log(np.maximum(net.frequency, 1))
    common, often = _common(counts, known)
    often = np.log(often)
    row, rare, times = (flat.fresh(docs, c) for c in ("_row", "_rare", "_times"))

    def make():
        own = Network(words, weights, group)
        first_shared = own.outside - own.shared

        def work(texts):
            hashes, first = _hashes(texts)
            word = own.classes(hashes)
            logs, sizes = _runs(own, word, first), np.diff(first)
            at = np.flatnonzero(word >= first_shared)
            logs[at] -= totals[word[at]]
            if len(common) and len(at):
                where, there = _find(common, hashes[at])
                logs[at[there]] += often[where[there]]
                at = at[~there]
            # each text's other words once, with their number
            of = np.searchsorted(first, at, "right") - 1
            order = np.lexsort((hashes[at], of))
            of, h = of[order], hashes[at][order]
            new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])][:len(h)])
            each = np.bincount(of[new], minlength=len(sizes))
            return [sizes, _sums(logs, first), _lists(pa.array(h[new].view(np.int64)), each), _lists(pa.array(np.diff(np.r_[new, len(h)]).astype(np.int32)), each)]

        return work

    lists = {rare: (T.ArrayType(T.LongType()), pa.list_(pa.int64())), times: (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))}
    scored = flat.with_columns(docs, text, {"n_tokens": long, "log_likelihood": double, **lists}, make).drop(text)
    # written once, so that a row's number stays the same
    scored = Kept(docs.sparkSession).keep(scored.withColumn(row, F.monotonically_increasing_id()))
    pairs = scored.select(F.col(row).alias("_r"), F.explode(F.arrays_zip(F.col(rare).alias("h"), F.col(times).alias("c"))).alias("p")).select("_r", "p.h", "p.c")
    more = pairs.join(counts.where("n > 1"), "h").groupBy("_r").agg(F.sum(F.col("c") * F.log("n")).alias("_more"))  # log 1 = 0
    full = scored.drop(rare, times).join(more, F.col(row) == F.col("_r"), "left")
    full = full.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("_more", F.lit(0.0))).drop(row, "_r", "_more")
    return full.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
