"""Arrow batches of text as flat numpy arrays: bytes, words, word hashes, hashes of word windows.

Everything here runs inside a task on one slice of a batch at a time, so memory follows the slice
(``SLICE_BYTES`` of text, or one longer text), never the partition.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20
U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_ROLL = U(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)

#: Bytes that separate words: ASCII white space only, or all ASCII but letters, digits and the underscore.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.array([b < 0x80 and not (chr(b).isalnum() or b == 0x5F) for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class _Powers:
    """1, b, b^2, ... modulo 2^64, grown on demand; so also of the inverse of b."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.r_[U(1), np.full(size - 1, b, np.uint64)]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_letters, _words = _Powers(int(_ODD)), _Powers(int(_ROLL))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text, or a single longer one."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0))
    ends, at = np.cumsum(lengths), 0
    while at < len(ends):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each text's words begin (one more entry than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every word's bytes."""
    up, down = _letters(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def rolling(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every run of ``width`` words inside one text, and where each text's runs begin."""
    n = len(words)
    up, down = _words(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    counts = np.maximum(np.diff(first) - width + 1, 0)
    at = np.repeat(first[:-1], counts) + within(counts)
    return mix((total[at + width] - total[at]) * down[at] + U(width)), np.r_[0, np.cumsum(counts)]


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``rolling``, but a text of 1 to ``width`` - 1 words has one shingle, all its words."""
    h, begin = rolling(words, first, width)
    sizes = np.diff(first)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if not len(short):
        return h, begin
    up, down = _words(len(words) + 1)
    total = np.r_[U(0), np.cumsum(words * up[:-1])]
    a, b = first[short], first[short + 1]
    counts = np.diff(begin)
    extra = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    h = np.insert(h, begin[short], extra)
    counts[short] = 1
    return h, np.r_[0, np.cumsum(counts)]


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the given group sizes."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def lower_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of lower-cased words; a word is a run of ASCII letters, digits, underscores and non-ASCII characters."""
    data, offsets = buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, first = bounds(data, offsets, NOT_WORD)
    return shingles(hashes(data, starts, ends), first, width)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, text: str, fields: dict[str, tuple[T.DataType, pa.DataType]], make: Callable[[], Callable[[pa.Array], list]], limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` and new columns, one Arrow slice of at most ``limit`` bytes of text at a time. ``make()`` runs once a task and gives the
    function from a slice's texts to the new arrays."""
    names = list(fields)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, fields[n][0]) for n in names]])
    at = df.columns.index(text)

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, batch.schema.names[at], limit):
                new = work(part.column(at))
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, fields[n][1]) for n, a in zip(names, new)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *names])

    return df.mapInArrow(run, schema)
