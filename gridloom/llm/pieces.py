"""SentencePiece encoding and decoding with a given BPE model file (byte fallback, dummy prefix, no normalisation).

Words are merged in vectorised rounds: all symbols of all new words of a slice lie in one flat array; a
round finds the smallest pair rank of every word, merges its leftmost such pair in all words at once
and closes the gaps, until no word has a pair left. No piece of such a model holds a space after another
character and none holds a line break, so texts fall apart into words exactly.

Null and empty texts have only the end id and decode to an empty text. Repeated texts give repeated rows.
"""
from __future__ import annotations

import codecs
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm import flat

#: Words with more characters are merged one by one with a heap: rounds over them would be quadratic.
LONG = 200
#: Words remembered by a task before its memory is emptied.
REMEMBERED = 400_000
_SPLIT = re.compile(r"\n| *[^ \n]+| +").findall
_NONE = np.iinfo(np.int32).max
codecs.register_error("byte_by_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """The tables of one model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.byte = np.full(256, self.unknown, np.int32)
        self.surface: list[bytes] = []
        score: dict[str, float] = {}
        ids: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif i == self.unknown:
                self.surface.append(" ⁇ ".encode())
            else:
                piece = piece.replace("▁", " ")
                self.surface.append(piece.encode())
                ids[piece], score[piece] = i, model.get_score(i)
        if any("\n" in p or " " in p.lstrip(" ") for p in ids):
            raise ValueError("this model has pieces across words")
        self.decimal = [str(i).encode() for i in range(size)]
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {(ids[p[:k]] << 20) | ids[p[k:]]: (order[score[p]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.ranks = np.array([pairs.get(int(k), (_NONE, 0))[0] for k in self.keys], np.int32)
        self.merged = np.array([pairs.get(int(k), (_NONE, 0))[1] for k in self.keys], np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; no such pair has the largest rank."""
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE).astype(np.int32), self.merged[at]

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges for one long word: smallest rank first, then leftmost."""
        n = len(symbols)
        sym, left, right = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        rank, result = self.lookup(symbols[:-1], symbols[1:])
        heap = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), result.tolist())) if r != _NONE]
        heapq.heapify(heap)
        dead, known = object(), {}

        def push(i, j):
            a, b = sym[i], sym[j]
            if (a, b) not in known:
                r, m = self.lookup(np.array([a], np.int32), np.array([b], np.int32))
                known[a, b] = int(r[0]), int(m[0])
            r, m = known[a, b]
            if r != _NONE:
                heapq.heappush(heap, (r, i, a, b, m))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = right[i]
            if sym[i] is dead or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j], right[i] = m, dead, right[j]
            if right[i] < n:
                left[right[i]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return np.array([s for s in sym if s is not dead], np.int32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = np.where(self.char[points] >= 0, self.char[points], -1 - points.astype(np.int32))
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        long = sizes > LONG
        if long.any():
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(long):
                own = self.merge_long(sym[ends[k] - sizes[k]:ends[k]])
                done.append((np.full(len(own), k), own))
            keep = ~long[word]
            sym, word = sym[keep], word[keep]
        rank, result = self._pairs(sym, word)
        while len(sym):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[begin, len(word)])
            least = np.minimum.reduceat(rank, begin)
            at = np.flatnonzero((rank == np.repeat(least, count)) & (rank != _NONE))
            at = at[np.r_[True, word[at][1:] != word[at][:-1]][:len(at)]]
            sym[at] = result[at]
            live = np.repeat(least != _NONE, count)
            done.append((word[~live], sym[~live]))
            keep = live
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            sym, word, rank, result = sym[keep], word[keep], rank[keep], result[keep]
            for i in (moved, moved[moved > 0] - 1):
                near = np.minimum(i + 1, len(sym) - 1)
                r, m = self.lookup(sym[i], sym[near])
                rank[i], result[i] = np.where((near > i) & (word[near] == word[i]), r, _NONE), m
        owner, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(owner, kind="stable")
        return self._bytes(ids[order], owner[order], len(words))

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, result = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            r, result[:-1] = self.lookup(sym[:-1], sym[1:])
            rank[:-1] = np.where(word[:-1] == word[1:], r, _NONE)
        return rank, result

    def _bytes(self, ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become the pieces of their UTF-8 bytes."""
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            times = np.ones(len(ids), np.int64)
            encoded = [chr(-1 - c).encode() for c in ids[lost].tolist()]
            times[lost] = [len(b) for b in encoded]
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[ids < 0] = self.byte[np.frombuffer(b"".join(encoded), np.uint8)]
        return ids, np.bincount(owner, minlength=n)


class Encoder:
    """Encodes slices of texts; keeps the pieces of words it has met."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.pool, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by the end id, and the offsets of the texts."""
        split = [_SPLIT(" " + t.replace("▁", " ")) if t else [] for t in texts]
        new = set().union(*split).difference(self.number)
        if len(self.number) + len(new) > REMEMBERED and self.number:
            self._forget()
            new = set().union(*split)
        if new:
            new = list(new)
            ids, counts = self.pieces.merge(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.begin = np.r_[self.begin, len(self.pool) + np.cumsum(counts) - counts]
            self.count, self.pool = np.r_[self.count, counts], np.r_[self.pool, ids]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter((n for ws in split for n in map(self.number.__getitem__, ws)), np.int64, int(sizes.sum()))
        counts = self.count[words]
        ids = self.pool[np.repeat(self.begin[words], counts) + flat.within(counts)]
        upto = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(sizes)]]
        ids = np.insert(ids, upto[1:], self.pieces.end)
        return ids, upto + np.arange(len(upto))

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids; the space put before the first word is taken off again."""
        surface = self.pieces.surface
        for k, i in enumerate(ids):
            if surface[i]:  # control ids before it don't count
                if surface[i][:1] == b" " and i != self.pieces.unknown:
                    return (surface[i][1:] + b"".join(map(surface.__getitem__, ids[k + 1:]))).decode("utf-8", "byte_by_byte")
                return b"".join(map(surface.__getitem__, ids[k:])).decode("utf-8", "byte_by_byte")
        return ""


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` as array<int> in column ``ids`` and, where ``decoded`` names a column, the text
    they give back, decoded in the same pass."""

    def make():
        encoder = Encoder(path)

        def work(texts):
            flat_ids, offsets = encoder.encode(texts.to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat_ids, pa.int32()))
            cuts = offsets.tolist()
            return [lists, *([[encoder.decode(flat_ids[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]] if decoded else [])]

        return work

    new = {ids: (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))}
    return flat.with_columns(docs, text, new | ({decoded: (T.StringType(), pa.string())} if decoded else {}), make, flat.SLICE_BYTES // 4)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids; null and empty lists give an empty text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())])
    at = docs.columns.index(ids)

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            new = pa.array([encoder.decode(x or []) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, text])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Number of ids, SHA-256 of the decimal ids joined by spaces and of the decoded text, of every row."""

    def make():
        encoder = Encoder(path)
        decimal = encoder.pieces.decimal

        def work(texts):
            flat_ids, offsets = encoder.encode(texts.to_pylist())
            flat_ids, cuts = flat_ids.tolist(), offsets.tolist()
            lists = [flat_ids[a:b] for a, b in zip(cuts, cuts[1:])]
            return [np.diff(offsets), [hashlib.sha256(b" ".join(map(decimal.__getitem__, x))).hexdigest() for x in lists],
                    [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in lists]]

        return work

    string = (T.StringType(), pa.string())
    return flat.with_columns(docs, text, {"n_tokens": (T.LongType(), pa.int64()), "ids_sha256": string, "decoded_sha256": string}, make).drop(text)
