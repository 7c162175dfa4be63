"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree to one feature after the other; the trees of a feature add up to one
value per bin of it, and a second pass does the same for the pairs of features that explain most of what is
left. A score is then a sum of table entries found by bin, and needs no tree.

Features come from the text alone. Nulls count as empty texts, which have features (all zero) and a score
like any other. Without labelled rows, or with one class only, every row gets the smoothed share of good ones.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import flat

#: Most labelled rows the fit takes, chosen by a hash of the id.
MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 60, 0.15, 4.0

_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@=<>^~_\\/{}[]", "!?", "|", ".,;:", " \t", "\n"]
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES, 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:] = len(_CLASSES) + 1
FEATURES = ["bytes", "words", "word_bytes", "word_bytes_spread", "longest_word", "upper", "digit", "symbol", "exclaim", "bar", "stop", "blank",
            "line", "non_ascii", "distinct_words", "repeated_neighbours", "most_frequent_word"]


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    data, offsets = flat.buffers(texts)
    size = np.diff(offsets)
    safe = np.maximum(size, 1)
    kind = _CLASS[data]
    shares = []
    for k in range(1, len(_CLASSES) + 2):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == k, out=total[1:])
        shares.append(np.diff(total[offsets]) / safe)
    starts, ends, first = flat.bounds(data, offsets)
    words = np.diff(first)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(len(words)), words)
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, length, len(words)) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length * length, len(words)) / some - mean * mean, 0))
    longest = np.zeros(len(words))
    full = words > 0
    if full.any():
        longest[full] = np.maximum.reduceat(length, first[:-1][full])
    h = flat.hashes(data, starts, ends)
    same = np.r_[False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])] if len(h) else np.zeros(0, bool)
    key = np.sort((owner.astype(np.uint64) << flat.U(40)) | (h >> flat.U(24)))
    new = np.r_[True, key[1:] != key[:-1]][:len(key)]
    at = np.flatnonzero(new)
    runs = np.diff(np.r_[at, len(key)])
    run_owner = owner[at]  # owners are sorted in both orders
    most = np.zeros(len(words))
    np.maximum.at(most, run_owner, runs)
    return np.column_stack([np.log1p(size), np.log1p(words), mean, spread, np.log1p(longest), *shares,
                            np.bincount(run_owner, minlength=len(words)) / some, np.bincount(owner, same, len(words)) / some, most / some])


@dataclass
class Model:
    """Cuts of every feature, one table per feature, and coarser cuts and a table per pair."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            z += table[np.searchsorted(cuts, x[:, k], "right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Step value of each bin of a tree of ``depth`` levels, by Newton gains on prefix sums."""
    value = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth == 0 or len(g) < 2:
        return value
    G, H = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = G * G / (H + RIDGE) + (g.sum() - G) ** 2 / (h.sum() - H + RIDGE)
    k = int(np.argmax(gain)) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9:
        return value
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over a grid of two features: split one, then each half by the other; the better order."""

    def halves(g, h):
        G, H = np.cumsum(g.sum(1))[:-1], np.cumsum(h.sum(1))[:-1]
        gain = G * G / (H + RIDGE) + (g.sum() - G) ** 2 / (h.sum() - H + RIDGE) if len(G) else np.zeros(0)
        k = int(np.argmax(gain)) + 1 if len(gain) else len(g)
        step = np.zeros_like(g)
        for part in (slice(0, k), slice(k, len(g))):
            if g[part].size:
                step[part] = _tree(g[part].sum(0), h[part].sum(0), 1)
        return step

    one, two = halves(g, h), halves(g.T, h.T).T
    return max((one, two), key=lambda s: float((s * g - 0.5 * s * s * (h + 1e-9)).sum()))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single features, then of the strongest pairs."""
    good = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(good / (1 - good))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [_cuts(c, BINS) for c in x.T]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    model.pair_cuts = [_cuts(c, PAIR_BINS) for c in x.T]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, x.T)]
    coarse = [np.searchsorted(c, v, "right") for c, v in zip(model.pair_cuts, x.T)]
    z = np.full(len(y), model.intercept)

    def gradient():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = gradient()
            step = RATE * _tree(np.bincount(b, g, len(model.tables[k])), np.bincount(b, h, len(model.tables[k])), 2)
            model.tables[k] += step
            z += step[b]
    g, h = gradient()
    found = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = (len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)
            cell = coarse[a] * shape[1] + coarse[b]
            G, H = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))
            step = _pair_tree(G, H)
            found.append((float((step * G - 0.5 * step * step * H).sum()), a, b, shape, cell))
    found.sort(key=lambda f: (-f[0], f[1], f[2]))
    chosen = [(a, b, np.zeros(shape), cell) for _, a, b, shape, cell in found[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table, cell in chosen:
            g, h = gradient()
            G, H = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h))
            step = RATE * _pair_tree(G, H)
            table += step
            z += step.ravel()[cell]
    model.pairs = [(a, b, table) for a, b, table, _ in chosen]
    return model


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % 3


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out third. Labels of 0 and 1 count,
    others and nulls don't; ids with contradicting labels keep the smaller one."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder() != 1)).groupBy("doc_id").agg(F.min(label).alias("y"))
    # the ids are chosen before any text is read, so only their texts move
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = F.broadcast(chosen)  # at most max_rows pairs of numbers
    texts = docs.select("doc_id", "text").join(rows, "doc_id")
    kind = (T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))
    told = flat.with_columns(texts, "text", {"x": kind}, lambda: lambda t: [list(features(t))]).select("doc_id", "y", "x").distinct()
    # an id may have many rows: the bound holds for rows too
    got = told.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(max_rows).toPandas()
    got = got.assign(k=got["x"].map(tuple)).sort_values(["doc_id", "k"])
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES)) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` and the probability of a good text."""
    return flat.with_columns(docs, text, {name: (T.DoubleType(), pa.float64())}, lambda: lambda t: [model.score(features(t))])
