"""Removal of passages that a document with a smaller id already has.

Every window of ``width`` words gets a Rabin-Karp hash. A task packs the windows of its rows by hash range into
blobs (7 bytes of hash, about 1.5 bytes of place for each window), of equal windows of its rows only those
of the smallest id: the other rows' are known to go. Spark shuffles the blobs; the task of a hash range sorts
its windows and names those whose hash a smaller id has, packed by document; a last shuffle brings them to the
texts, where overlapping windows merge into maximal intervals. No row per window leaves a task, and a window
that a third of all rows have is one entry per task.

Words are runs of bytes other than ASCII white space. Hashes have 64 bits: two different windows are taken
for equal with a chance of 5e-20 a pair. Rows with one id never remove each other's windows; rows without an
id neither remove nor lose words. Null and empty texts have no words.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import flat

WINDOW = 13
#: Hash ranges: a power of 2, of at least this many, and no fewer than the shuffle partitions.
LEAST_RANGES = 64
#: Windows that a task holds before it packs them.
GATHER = 2_500_000

BLOB = "place long, docs binary, prints binary, counts binary, hashes binary, starts binary, more binary"
_NAMES = ["place", "docs", "prints", "counts", "hashes", "starts", "more"]


def _small(v: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers below 2^31 as one byte each, and (index, rest) of the larger ones."""
    high = np.flatnonzero(v >> 8)
    return (v & 255).astype(np.uint8).tobytes(), np.concatenate([high, v[high] >> 8]).astype(np.uint32).tobytes()


def _large(low: bytes, more: bytes) -> np.ndarray:
    v = np.frombuffer(low, np.uint8).astype(np.int64)
    high = np.frombuffer(more, np.uint32).astype(np.int64)
    k = len(high) // 2
    v[high[:k]] += high[k:] << 8
    return v


def pack(place: int, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, h: np.ndarray | None) -> tuple:
    """One blob of windows sorted by (document, mark, start): documents once each, starts as differences."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])][:len(doc)])
    counts = np.diff(np.r_[new, len(doc)])
    step = np.diff(start, prepend=0)
    step[new] = start[new]
    low, more = _small(step)
    ids = np.diff(doc[new], prepend=0)
    narrow = np.abs(ids).max(initial=0) < 2**31
    docs = b"\0" + ids.astype("<i4").tobytes() if narrow else b"\1" + ids.astype("<i8").tobytes()
    seven = b"" if h is None else h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()
    return place, docs, mark[new].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), seven, low, more


def unpack(docs: bytes, prints: bytes, counts: bytes, hashes: bytes, starts: bytes, more: bytes) -> tuple[np.ndarray, ...]:
    ids = np.cumsum(np.frombuffer(docs, "<i4" if docs[0] == 0 else "<i8", offset=1).astype(np.int64))
    counts = np.frombuffer(counts, "<u4").astype(np.int64)
    step = _large(starts, more)
    first = np.cumsum(counts) - counts
    total = np.cumsum(step)
    start = total - np.repeat(total[first] - step[first], counts) if len(step) else step
    h = np.zeros((len(step), 8), np.uint8)
    if len(hashes):
        h[:, :7] = np.frombuffer(hashes, np.uint8).reshape(7, -1).T
    return np.repeat(ids, counts), np.repeat(np.frombuffer(prints, "<u4"), counts), start, h.view("<u8").ravel()


def _windows(texts: pa.Array, width: int):
    data, offsets = flat.buffers(texts)
    starts, ends, first = flat.bounds(data, offsets)
    h, begin = flat.rolling(flat.hashes(data, starts, ends), first, width)
    return data, starts, ends, first, h, begin


def _marks(texts: pa.Array) -> np.ndarray:
    """32 bits of each text's bytes, to tell rows of one id apart."""
    data, offsets = flat.buffers(texts)
    return (flat.hashes(data, offsets[:-1], offsets[1:]) >> flat.U(32)).astype(np.uint32)


def _home(doc: np.ndarray, places: int) -> np.ndarray:
    """Where a document meets the windows it loses: -1 to -places, apart from the hash ranges."""
    doc = doc.astype(np.int64).view(np.uint64)
    folded = doc ^ (doc >> flat.U(6)) ^ (doc >> flat.U(12)) ^ (doc >> flat.U(24)) ^ (doc >> flat.U(36))
    return -1 - (folded & flat.U(places - 1)).astype(np.int64)


def home(doc: str, places: int):
    """The same as a column."""
    folded = F.col(doc)
    for k in (6, 12, 24, 36):
        folded = folded.bitwiseXOR(F.shiftrightunsigned(doc, k))
    return F.lit(-1).cast("long") - folded.bitwiseAND(F.lit(places - 1).cast("long"))


def _send(place, doc, mark, start, h):
    """Blobs of windows that are sorted by (document, mark, start), one for each place."""
    order = np.argsort(place.astype(np.int32), kind="stable")
    place, doc, mark, start = place[order], doc[order], mark[order], start[order]
    h = None if h is None else h[order]
    cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][:len(place)])
    rows = [pack(int(place[a]), doc[a:b], mark[a:b], start[a:b], None if h is None else h[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(place)])]
    kinds = [pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], _NAMES)


def _settle(doc, mark, h):
    """Of windows sorted by (document, mark, start), of each hash: which to pass on (the first of each row
    of the smallest id), and which go for certain (the first of each row of other ids)."""
    order = np.argsort(h, kind="stable")
    hs, ds, ms = h[order], doc[order], mark[order]
    new = np.r_[True, hs[1:] != hs[:-1]][:len(hs)]
    row = new | np.r_[True, (ds[1:] != ds[:-1]) | (ms[1:] != ms[:-1])][:len(ds)]
    least = ds == ds[np.flatnonzero(new)][np.cumsum(new) - 1] if len(ds) else new
    keep, gone = np.zeros(len(h), bool), np.zeros(len(h), bool)
    keep[order], gone[order] = least & row, ~least & row
    return keep, gone


def _scan(batches, width, ranges, places):
    shift = flat.U(65 - int(ranges).bit_length())
    held: list[tuple] = []
    n = 0

    def flush():
        rows = sorted(held, key=lambda r: r[:2])
        sizes = [len(r[2]) for r in rows]
        doc, mark = (np.repeat(np.array([r[k] for r in rows], t), sizes) for k, t in ((0, np.int64), (1, np.uint32)))
        start, h = flat.within(np.array(sizes)), np.concatenate([r[2] for r in rows])
        keep, gone = _settle(doc, mark, h)
        yield _send((h[keep] >> shift).astype(np.int64), doc[keep], mark[keep], start[keep], h[keep])
        yield _send(_home(doc[gone], places), doc[gone], mark[gone], start[gone], None)

    for batch in batches:
        for part in flat.slices(batch, batch.schema.names[1]):
            *_, h, begin = _windows(part.column(1), width)
            for k, (doc, mark) in enumerate(zip(part.column(0).to_pylist(), _marks(part.column(1)).tolist())):
                if begin[k] < begin[k + 1]:
                    held.append((doc, mark, h[begin[k]:begin[k + 1]]))
            n += len(h)
            if n >= GATHER:
                yield from flush()
                held, n = [], 0
    if held:
        yield from flush()


def _unpacked(table):
    rows = [unpack(*row) for row in zip(*(table.column(n).to_pylist() for n in _NAMES[1:]))]
    doc, mark, start, h = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    del rows
    order = np.lexsort((start, mark, doc))
    return doc[order], mark[order], start[order], h[order] if len(h) else h


def _resolve(key, table, places):
    """Windows of one hash range that a smaller id has; what is already known to go passes through."""
    if key[0].as_py() < 0:
        return table
    doc, mark, start, h = _unpacked(table)
    _, gone = _settle(doc, mark, h)
    return pa.Table.from_batches([_send(_home(doc[gone], places), doc[gone], mark[gone], start[gone], None)])


def _cut(texts, lost, width):
    """doc_id, number of words, of lost words, and hash of the kept ones, of each text."""
    doc, mark, start = lost
    out = []
    for batch in texts.combine_chunks().to_batches():
        for part in flat.slices(batch, "text"):
            data, starts, ends, first, h, begin = _windows(part.column("text"), width)
            ids, own = part.column("doc_id"), _marks(part.column("text"))
            raw, sizes, removed, digests = data.tobytes(), np.diff(first), [], []
            for k, i in enumerate(ids.to_pylist()):
                a, b = (0, 0) if i is None else np.searchsorted(doc, [i, i + 1])
                if a < b:
                    a, b = a + np.searchsorted(mark[a:b], [int(own[k]), int(own[k]) + 1])
                words = np.arange(first[k], first[k + 1])
                if a < b:
                    mine = h[begin[k]:begin[k + 1]]
                    at = np.flatnonzero(np.isin(mine, mine[start[a:b]]))  # its repeats in this row too
                    edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + width, minlength=len(words) + 1)
                    words = words[np.cumsum(edge)[:-1] == 0]
                removed.append(int(sizes[k]) - len(words))
                digests.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(starts[words].tolist(), ends[words].tolist())])).hexdigest())
            out.append(pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]))
    return out


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def removals(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of kept words joined by one space)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << (max(LEAST_RANGES, partitions) - 1).bit_length()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = source.where("doc_id is not null")
    blobs = known.mapInArrow(lambda b: _scan(b, width, ranges, ranges), BLOB)
    lost = blobs.groupBy("place").applyInArrow(lambda k, t: _resolve(k, t, ranges), BLOB)
    homed = known.withColumn("place", home("doc_id", ranges))
    nothing = (np.zeros(0, np.int64),) * 3

    def cut(texts, gone):
        out = _cut(texts, _unpacked(gone)[:3], width)
        return pa.Table.from_batches(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    done = homed.groupBy("place").cogroup(lost.groupBy("place")).applyInArrow(cut, RESULT)
    free = source.where("doc_id is null").mapInArrow(lambda b: (r for x in b for r in _cut(pa.Table.from_batches([x]), nothing, width)), RESULT)
    return done.union(free)
