"""Jaccard join of n-gram sets by prefix trees.

A document's set are its distinct ``width``-word shingles. Equal sets are one node. A node can only be linked if four
fifths of its shingles occur in another set too; a first count, packed by hash range, keeps those nodes alone.
Their sets are put into one global order, rarest shingle first, and stored as tries: a compressed trie's edge holds the run
of shingles that all sets below it continue with. A probing set walks down level by level; what it has in common with a
path is counted once for all sets that share the path. A subtree goes where the overlap so far and what can still come (the
shorter of both rests) stays below what the smallest set in it needs, and where all its sets are already connected to the probe.

Linked sets share a shingle within the first n - ceil(0.8 n) + 1 of both. First every set meets those with the same one of
three such shingles (its most frequent one, and those with the least of two hashes), one trie for each (large ones in blocks of
about ``BLOCK`` shingles); that connects groups of near copies in about their own size. Then every prefix shingle whose holders
are not yet in one component gets a trie of what they have from this shingle on; those outside the largest component
probe it. Before, holders go whose size and place of the shingle allow no link with any size around in another
component. Pairs whose first common shingle is an earlier one met there, so no link between different components is
lost, and no pair is emitted that doesn't connect anything new.

Every row of ``docs`` is a document. Null, empty and word-less texts have no shingles and no links: their component
is their own id. Rows without an id link like all others; a component's id is its smallest id (null if none has one). Rows with one id and
different texts may lie in different components. Other columns are ignored, whatever their names; empty tables give no rows.
Shingles and sets are compared by 64-bit hashes. Sizes and overlaps are exact.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import flat
from gridloom.llm.links import Kept, components
from gridloom.llm.ranked import LOWER

WIDTH = 5
#: Sizes within this ratio are judged together, by the smallest.
STEP = 1.02
#: Shingles that a task holds before it packs them, bytes of a hash range, shingles of a trie.
GATHER, RANGE_BYTES, BLOCK = 700_000, 8 << 20, 1 << 20
#: Bytes of text hashed at once; hashing takes about 40 bytes for each.
SLICE = 1 << 20


def sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and where each text's begin."""
    data, offsets = flat.buffers(texts)
    data = LOWER[data]
    starts, ends, first = flat.bounds(data, offsets)
    h, begin = flat.shingles(flat.hashes(data, starts, ends), first, width)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][:len(h)]
    return h[new], np.searchsorted(text[new], np.arange(len(begin)))


def _nodes(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.r_[flat.U(0), np.cumsum(flat.mix(h ^ flat.U(0x5D)))]
    return flat.mix(total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(np.uint64)).view(np.int64)


def _place(h: np.ndarray, places: int) -> np.ndarray:
    """Hash range of each hash, ascending."""
    return ((h >> flat.U(32)) * flat.U(places) >> flat.U(32)).astype(np.int64)


_ASKED = "place long, chunk long, ids array<long>, nodes binary, sizes binary, hashes binary, counts binary"
_FIELDS = [("place", pa.int64()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("nodes", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())]


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * 7, _FIELDS)], [n for n, _ in _FIELDS])


def _chunks(batches, width):
    """Runs of rows of about GATHER shingles: ids, nodes, sizes, shingles."""
    ids, held, n = [], [], 0

    def together():
        return ids, *(np.concatenate([x[k] for x in held]) for k in range(3))

    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[1], SLICE):
            h, begin = sets(part.column(1), width)
            ids += part.column(0).cast(pa.int64()).to_pylist()
            held.append((_nodes(h, begin), np.diff(begin), h))
            n += len(h)
            if n >= GATHER:
                yield together()
                ids, held, n = [], [], 0
    if ids:
        yield together()


def _seven(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, byte by byte."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def _six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return out.view("<u8").ravel()


def _ask(batches, width, places):
    """For each chunk one row about its documents, and one for each hash range with the shingles that only one set of the
    chunk has, by set, and then those that several have."""
    for number, (ids, nodes, sizes, h) in enumerate(_chunks(batches, width)):
        chunk = (TaskContext.get().partitionId() << 32) + number
        _, at = np.unique(nodes, return_index=True)
        lead = np.zeros(len(ids), bool)
        lead[at] = True
        own = np.repeat(np.arange(len(ids)), sizes)
        keep = lead[own]
        h, own = h[keep], own[keep]
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        first = np.r_[True, h[1:] != h[:-1]][:len(h)]
        several = np.r_[~first[1:], False][:len(h)] | ~first
        local = np.bincount(own[several], minlength=len(ids))
        h, own = h[first], np.where(several, len(ids), own)[first]
        yield _asked([(-1 - chunk, chunk, ids, nodes.tobytes(), sizes.astype("<i8").tobytes(), None, local.astype("<i8").tobytes())])
        cut = np.searchsorted(_place(h, places), np.arange(places + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[p], cut[p + 1]
            order = np.argsort(own[a:b], kind="stable")
            yield _asked([(p, chunk, None, None, None, _seven(h[a:b][order]), np.bincount(own[a:b], minlength=len(ids) + 1).astype("<u4").tobytes())])


def _answer(table: pa.Table) -> pa.Table:
    """How many of each set's shingles in one hash range another chunk has too."""
    if table.column("place")[0].as_py() < 0:
        return table
    chunks = table.column("chunk").to_pylist()
    hashes = [_six(x) for x in table.column("hashes").to_pylist()]
    counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    first = np.r_[True, h[order][1:] != h[order][:-1]]
    several = np.zeros(len(h), bool)
    several[order] = ~first | np.r_[~first[1:], False]
    out, at = [], 0
    for chunk, n in zip(chunks, counts):
        own = np.repeat(np.arange(len(n)), n)
        out.append((-1, chunk, None, None, None, None, np.bincount(own[several[at:at + len(own)]], minlength=len(n))[:-1].astype("<i8").tobytes()))
        at += len(own)
    return pa.Table.from_batches([_asked(out)])


_ROWS = "doc_id long, node long, n long, live long"


def _summed(table: pa.Table) -> pa.Table:
    """Documents of one chunk with the number of their shingles that another set has."""
    live = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
    about = next(r for r in zip(*(table.column(c).to_pylist() for c in ("ids", "nodes", "sizes"))) if r[0] is not None)
    nodes = np.frombuffer(about[1], "<i8")
    _, at, back = np.unique(nodes, return_index=True, return_inverse=True)
    return pa.table([pa.array(about[0], pa.int64()), pa.array(nodes), pa.array(np.frombuffer(about[2], "<i8")), pa.array(live[at][back])], names=["doc_id", "node", "n", "live"])


_ORDER = "place long, chunk long, nodes binary, sizes binary, hashes binary, counts binary"


def _ordered_rows(rows):
    kinds = [t for n, t in _FIELDS if n != "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["place", "chunk", "nodes", "sizes", "hashes", "counts"])


def _tally(batches, places):
    """Packed sets of each chunk, and for each hash range its distinct shingles with the number of sets."""
    def packed(held, chunk):
        h = np.concatenate([np.frombuffer(x, "<u8") for _, x in held])
        nodes = np.array([x for x, _ in held], "<i8")
        sizes = np.array([len(x) // 8 for _, x in held], "<i8")
        yield _ordered_rows([(-1 - chunk, chunk, nodes.tobytes(), sizes.tobytes(), h.tobytes(), None)])
        u, n = np.unique(h, return_counts=True)
        cut = np.searchsorted(_place(u, places), np.arange(places + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            yield _ordered_rows([(p, chunk, None, None, u[cut[p]:cut[p + 1]].tobytes(), n[cut[p]:cut[p + 1]].astype("<i8").tobytes())])

    held, n, number = [], 0, 0
    for batch in batches:
        for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist()):
            held.append((node, raw))
            n += len(raw) // 8
            if n >= GATHER:
                yield from packed(held, (TaskContext.get().partitionId() << 32) + number)
                held, n, number = [], 0, number + 1
    if held:
        yield from packed(held, (TaskContext.get().partitionId() << 32) + number)


def _frequency(table: pa.Table) -> pa.Table:
    """The number of sets of each shingle in one hash range, sent back to each chunk in the chunk's order."""
    if table.column("place")[0].as_py() < 0:
        return table
    hashes = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
    _, back = np.unique(np.concatenate(hashes), return_inverse=True)
    n = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist()])
    total = np.zeros(back.max() + 1, np.int64)
    np.add.at(total, back, n)
    parts = np.split(total[back], np.cumsum([len(x) for x in hashes])[:-1])
    return pa.Table.from_batches([_ordered_rows([(p, c, None, None, None, x.tobytes()) for p, c, x in zip(table.column("place").to_pylist(), table.column("chunk").to_pylist(), parts)])])


_SETS = "node long, n long, shingles binary, prefix array<long>, homes array<long>, size long"


def _in_order(table: pa.Table) -> pa.Table:
    """Sets of one chunk in the global order, without shingles that no other set has; sets without a chance go."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "nodes", "sizes", "hashes", "counts"))), key=lambda r: r[0])
    _, nodes, sizes, h, _ = rows[0]
    nodes, sizes, h = np.frombuffer(nodes, "<i8"), np.frombuffer(sizes, "<i8"), np.frombuffer(h, "<u8")
    df = np.concatenate([np.frombuffer(r[4], "<i8") for r in rows[1:]])[np.searchsorted(np.unique(h), h)]
    own = np.repeat(np.arange(len(nodes)), sizes)
    order = np.lexsort((h, df, own))
    h, df, own = h[order], df[order], own[order]
    keep = df > 1
    h, df, own = h[keep], df[keep], own[keep]
    begin = np.searchsorted(own, np.arange(len(nodes) + 1))
    out = []
    for k, n in enumerate(sizes.tolist()):
        a, b = begin[k], begin[k + 1]
        upto = n - (4 * n + 4) // 5 + 1 - (n - (b - a))
        if upto > 0 and a < b:
            prefix = h[a:min(a + upto, b)]
            homes = {int(np.searchsorted(df[a:a + len(prefix)], df[a + len(prefix) - 1])), *(int(np.argmin(flat.mix(prefix ^ flat.U(seed)))) for seed in (1, 2))}
            prefix = prefix.view(np.int64).tolist()
            out.append((int(nodes[k]), n, h[a:b].tobytes(), prefix, [prefix[x] for x in sorted(homes)], int(b - a)))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["node", "n", "shingles", "prefix", "homes", "size"])


class Trie:
    """A compressed trie of sequences in one common order."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        self.vocabulary, ids = np.unique(np.concatenate(sequences), return_inverse=True)
        lengths = np.array([len(s) for s in sequences])
        begin = np.r_[0, np.cumsum(lengths)]
        big = ids.astype(">u4")
        keys = [big[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        begin, lengths = begin[:-1][self.order], lengths[self.order]
        shared = [0]
        for k in range(1, len(keys)):
            m = min(lengths[k - 1], lengths[k])
            other = np.flatnonzero(ids[begin[k - 1]:begin[k - 1] + m] != ids[begin[k]:begin[k] + m])
            shared.append(int(other[0]) if len(other) else int(m))
        self._branch(shared, lengths)
        self.elements, self.begin, self.lengths, self.n = ids, begin, lengths, sizes[self.order]
        span = np.c_[self.low, self.high + 1].ravel()
        self.least_n = np.minimum.reduceat(np.r_[self.n, 1 << 60], span)[::2]
        self.most_length = np.maximum.reduceat(np.r_[lengths, -1], span)[::2]

    def _branch(self, shared: list[int], lengths: np.ndarray) -> None:
        """Nodes: depth range of the edge, leaf range, children."""
        count = len(shared)
        end, low, high, parent = [0], [0], [count - 1], [-1]  # node 0 is the root
        stack = [0]
        for k in range(count):
            depth, last = shared[k], None
            while end[stack[-1]] > depth:
                last = stack.pop()
                high[last] = k - 1
            if last is not None and end[stack[-1]] < depth:
                end.append(depth), low.append(low[last]), high.append(-1), parent.append(stack[-1])
                parent[last] = len(end) - 1
                stack.append(len(end) - 1)
            # the sequence itself, an edge of no length if a longer one begins with it
            end.append(int(lengths[k])), low.append(k), high.append(k), parent.append(stack[-1])
            if k + 1 < count and shared[k + 1] > end[stack[-1]]:
                if shared[k + 1] < lengths[k]:
                    stack.append(len(end) - 1)  # popped, and split, by the next one
                else:  # the whole sequence goes on: an inner node above its leaf
                    parent.append(len(end) - 1), end.append(int(lengths[k])), low.append(k), high.append(k)
                    stack.append(len(end) - 2)
        while len(stack) > 1:
            high[stack.pop()] = count - 1
        self.end, self.low, self.high, self.parent = map(np.array, (end, low, high, parent))
        self.start = np.where(self.parent >= 0, self.end[self.parent], 0)
        inner = np.bincount(self.parent[1:], minlength=len(end))
        self.leaf = inner == 0
        self.by_parent = 1 + np.argsort(self.parent[1:], kind="stable")
        self.child = np.r_[0, np.cumsum(inner)]

    def label(self, labels: np.ndarray) -> None:
        """Components of the sets, in their original order."""
        self.labels = labels[self.order]
        self._changes()

    def _changes(self) -> None:
        self.change = np.cumsum(np.r_[0, self.labels[1:] != self.labels[:-1]])

    def probe(self, sequence: np.ndarray, n: int, label: int) -> list[int]:
        """Sets (original numbers), one or more of each other component that the probe is linked to."""
        at = np.searchsorted(self.vocabulary, sequence)
        at[at == len(self.vocabulary)] = 0
        has = np.flatnonzero(self.vocabulary[at] == sequence)
        where = np.zeros(len(self.vocabulary), np.int64)
        where[at[has]] = has + 1
        nodes, overlap, last, found = np.array([0]), np.array([0]), np.array([0]), []
        while len(nodes):
            leaves = self.leaf[nodes]
            if leaves.any():
                k = self.low[nodes[leaves]]
                k = k[(9 * overlap[leaves] >= 4 * (n + self.n[k])) & (self.labels[k] != label)]
                found += k.tolist()
            sizes = self.child[nodes + 1] - self.child[nodes]
            overlap, last = np.repeat(overlap, sizes), np.repeat(last, sizes)
            nodes = self.by_parent[np.repeat(self.child[nodes], sizes) + flat.within(sizes)]
            other = (self.change[self.high[nodes]] != self.change[self.low[nodes]]) | (self.labels[self.low[nodes]] != label)
            nodes, overlap, last = nodes[other], overlap[other], last[other]
            size = self.end[nodes] - self.start[nodes]
            edge = np.repeat(np.arange(len(nodes)), size)
            hit = where[self.elements[np.repeat(self.begin[self.low[nodes]] + self.start[nodes], size) + flat.within(size)]]
            overlap = overlap + np.bincount(edge[hit > 0], minlength=len(nodes))
            last = last.copy()
            np.maximum.at(last, edge[hit > 0], hit[hit > 0])
            rest = np.minimum(len(sequence) - last, self.most_length[nodes] - self.end[nodes])
            keep = 9 * (overlap + rest) >= 4 * (n + self.least_n[nodes])
            nodes, overlap, last = nodes[keep], overlap[keep], last[keep]
        return [int(self.order[k]) for k in found]

    def join(self, old: int, new: int) -> None:
        self.labels[self.labels == old] = new
        self._changes()


def links(members: list[tuple], probes: list[tuple]) -> list[tuple[int, int]]:
    """Links (node, node) from probes to members, each (node, n, sequence, label), that connect components."""
    trie = Trie([m[2] for m in members], np.array([m[1] for m in members]))
    trie.label(np.array([m[3] for m in members], np.int64))
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for node, n, sequence, label in probes:
        label = find(label)
        for k in trie.probe(sequence, n, label):
            other = find(members[k][3])
            if other != label:
                out.append((node, members[k][0]))
                root[other] = label
                trie.join(other, label)
    return out


_LINKS = "a long, b long"


def _linked(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _at_home(table: pa.Table) -> pa.Table:
    rows = [(node, n, np.frombuffer(raw, "<u8"), node) for node, n, raw in zip(*(table.column(c).to_pylist() for c in ("node", "n", "shingles")))]
    return _linked(links(rows, rows) if len(rows) > 1 else [])


def _at_shingle(table: pa.Table) -> pa.Table:
    """Members and probes of one shingle, of which all that precedes it has been dealt with."""
    members, probes = [], []
    for e, node, n, raw, label, asks in zip(*(table.column(c).to_pylist() for c in ("e", "node", "n", "shingles", "label", "asks"))):
        h = np.frombuffer(raw, "<u8")
        at = np.flatnonzero(h == np.int64(e).view(np.uint64))[0]
        (probes if asks else members).append((node, n, h[at:], label))
    return _linked(links(members, probes) if members and probes else [])


def _name(batches, width):
    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[0], SLICE):
            h, begin = sets(part.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(h, begin)), pa.array([h[a:b].tobytes() for a, b in zip(begin.tolist(), begin[1:].tolist())], pa.binary())], ["node", "shingles"])


def _candidates(source: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of every set that enough of its shingles could link."""
    nodes = rows.where("n > 0 and 100 * live >= 80 * n").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = nodes.select("doc_id").distinct().withColumnRenamed("doc_id", "its")
    texts = source.join(ids, source["doc_id"].eqNullSafe(F.col("its")), "left_semi").select("text")
    found = texts.mapInArrow(lambda b: _name(b, width), "node long, shingles binary").join(nodes.select("node"), "node", "left_semi")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    kept = Kept(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    octets = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    places = 1 + octets // RANGE_BYTES
    asked = source.mapInArrow(lambda b: _ask(b, width, places), _ASKED)
    answers = asked.groupBy("place").applyInArrow(lambda t: _answer(t), _ASKED)
    rows = kept.keep(answers.groupBy("chunk").applyInArrow(lambda t: _summed(t), _ROWS))
    found = kept.keep(_candidates(source, rows, width))
    octets = found.agg(F.coalesce(F.sum(F.octet_length("shingles").cast("long")), F.lit(0))).first()[0]
    places = 1 + octets // RANGE_BYTES
    tallied = found.mapInArrow(lambda b: _tally(b, places), _ORDER).groupBy("place").applyInArrow(lambda t: _frequency(t), _ORDER)
    ordered = kept.keep(tallied.groupBy("chunk").applyInArrow(lambda t: _in_order(t), _SETS))
    kept.forget(found)

    def blocks(size):
        return F.ceil(size / BLOCK).cast("long")

    # the tries of the three homes of each set
    settled = ordered.select(F.explode("homes").alias("home"), "node", "n", "shingles", "size")
    homes = settled.groupBy("home").agg(F.count("*").alias("count"), blocks(F.sum("size")).alias("blocks")).where("count > 1")
    at_home = settled.join(homes.select("home", "blocks"), "home").select("home", F.expr("pmod(node, blocks)").alias("block"), "node", "n", "shingles")
    first = kept.keep(at_home.groupBy("home", "block").applyInArrow(lambda t: _at_home(t), _LINKS))
    labels = components(first, kept)
    # what each holder of a prefix shingle can still have in common with others, and whom that is enough for
    named = ordered.select("node", "n", "size", F.posexplode("prefix").alias("at", "e")).join(labels, "node", "left")
    named = named.select("e", "node", "n", "size", (9 * (F.col("size") - F.col("at")) - 4 * F.col("n")).alias("spare"), F.coalesce("label", "node").alias("label"))
    named = kept.keep(named.withColumn("step", F.floor(F.log("n") / np.log(STEP))))
    around = named.groupBy("e", "step").agg(F.min("n").alias("n"), F.max("spare").alias("spare"), F.min("label").alias("low"), F.max("label").alias("high"))
    around = around.groupBy("e").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list(F.struct("n", "spare", "low", "high")).alias("around")).where("low <> high")
    able = F.exists("around", lambda y: (4 * y["n"] <= F.col("spare")) & (y["spare"] >= 4 * F.col("n")) & ((y["low"] != y["high"]) | (y["low"] != F.col("label"))))
    open_ = kept.keep(named.join(around.select("e", "around"), "e").where(able).select("e", "node", "size", "label"))
    several = open_.groupBy("e", "label").agg(F.count("*").alias("count"), F.sum("size").alias("size")).groupBy("e")
    several = several.agg(F.count("*").alias("labels"), F.max_by("label", F.struct("count", "label")).alias("major"), blocks(F.sum("size")).alias("blocks")).where("labels > 1")
    mixed = open_.join(several.select("e", "major", "blocks"), "e")
    members = mixed.select("e", F.expr("pmod(node, blocks)").alias("block"), "node", "label", F.lit(False).alias("asks"))
    probes = mixed.where("label <> major").select("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "node", "label", F.lit(True).alias("asks"))
    met = members.union(probes).join(ordered.select("node", "n", "shingles"), "node")
    more = met.groupBy("e", "block").applyInArrow(lambda t: _at_shingle(t), _LINKS)
    final = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), kept)
    kept.forget(first, labels, named, open_, ordered)
    own = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = kept.keep(own)
    smallest = own.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = own.join(smallest, "label").select("node", "component_id")
    return rows.where("n > 0").join(by_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(
        rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
